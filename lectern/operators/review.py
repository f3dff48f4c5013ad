"""Reviews: pluggable reviewers, rule tools by name, and the combination of their findings."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import replies
from lectern.operators import candidates, rules, sections
from lectern.operators.metrics import issue_summary
from lectern.operators.storage import open_store, stored

#: A reviewer takes section rows and gives findings with doc_id and the output columns.
Reviewer = Callable[[DataFrame], DataFrame]


#: A client answers a prompt, or a prompt and its system text where prompts have a column system.
Client = Callable[..., str]


def asked(prompts: DataFrame, client: Client) -> DataFrame:
    """Replies of a model to prompts (doc_id, prompt, maybe system, and others), through a client that the caller brings.

    The other columns stay; reply is null and failed is true where the call raised an error.
    """
    schema, has_system = prompts.drop("prompt", "system").schema, "system" in prompts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, failed = [], []
            for at, p in enumerate(b["prompt"]):
                try:
                    reply = client(p, b["system"].iloc[at]) if has_system else client(p)
                    out.append(reply)
                    failed.append(False)
                except Exception:  # noqa: BLE001  any failure of a service is no answer
                    out.append(None)
                    failed.append(True)
            yield b[schema.names].assign(reply=out, failed=failed)

    return prompts.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", reply string, failed boolean")


#: Calls of one task that run at once; tries of a call; seconds before the second try, which double.
CALLS, TRIES, PAUSE = 8, 3, 1.0


def _answered(client: Client, prompt: str, system: str | None, tries: int, pause: float) -> tuple[str | None, bool]:
    """Reply and failure of a call, tried again after growing pauses."""
    for n in range(tries):
        try:
            return (client(prompt) if system is None else client(prompt, system)), False
        except Exception:  # noqa: BLE001  any failure of a service is no answer
            if n + 1 < tries:
                time.sleep(pause * 2**n)
    return None, True


def _journal(client: Client, path: str, calls: int, tries: int, pause: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Asks a task's prompts, `calls` at a time; each group's replies are a file named by its digests before the next group is asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = open_store(path)
        store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(calls) as pool:
            for b in batches:
                for at in range(0, len(b), calls):
                    part = b.iloc[at : at + calls]
                    name = f"{folder}/{hashlib.sha256(''.join(part['digest']).encode()).hexdigest()}.json"
                    if store.get_file_info(name).type == pafs.FileType.NotFound:  # a task that runs again finds what it asked before
                        said = list(pool.map(lambda r: _answered(client, r.prompt, r.system, tries, pause), part.itertuples()))
                        lines = [json.dumps({"digest": d, "reply": r, "failed": f}) + "\n" for d, (r, f) in zip(part["digest"], said, strict=True)]
                        half = f"{folder}/_{uuid.uuid4().hex}"
                        with store.open_output_stream(half) as out:
                            out.write("".join(lines).encode())
                        store.move(half, name)
                    yield part[["digest"]]

    return run


def asked_once(prompts: DataFrame, client: Client, path: str, calls: int = CALLS, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """As asked(), through a folder of replies keyed by the digest of prompt and system text; a prompt with a reply there is not asked.

    Distinct prompts are dealt by digest and sorted, so a task that runs again, or a job after it, goes through the
    same groups and reads those that are there: at most the `calls` calls under way in a lost task are made
    twice. Failed calls are tried again with growing pauses, and asked anew by the next job. Prompts are not collected.
    """
    spark, has_system = prompts.sparkSession, "system" in prompts.columns
    system = F.col("system") if has_system else F.lit(None).cast("string")
    digest = F.sha2(F.concat(F.coalesce(F.concat(F.lit("s"), system, F.lit("\0")), F.lit("")), F.coalesce("prompt", F.lit(""))), 256)
    keyed = prompts.withColumn("_digest", digest)

    def known() -> DataFrame:
        found = spark.read.schema("digest string, reply string, failed boolean").option("recursiveFileLookup", True).json(path).groupBy("digest").agg(F.min(F.struct("failed", "reply")).alias("x"))  # an answer before a failure
        return found.select(F.col("digest").alias("_digest"), "x.reply", "x.failed")

    store, folder = open_store(path)
    store.create_dir(folder, recursive=True)
    asks = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first("prompt").alias("prompt"), F.first(system).alias("system"))
    left = asks.join(known().where("not failed").withColumnRenamed("_digest", "digest"), "digest", "left_anti")
    dealt = stored(left, "asks").repartition("digest").sortWithinPartitions("digest")
    round_ = uuid.uuid4().hex  # failures of earlier jobs are asked again
    dealt.mapInPandas(_journal(client, f"{path}/{round_}", calls, tries, pause), "digest string").write.format("noop").mode("overwrite").save()
    return keyed.join(stored(known(), "replies"), "_digest").drop("_digest", "prompt", "system")


def predictions_of(replied: DataFrame) -> DataFrame:
    """Items of replies in order: doc_id, pred_index and the item's fields."""
    rows = replied.select("doc_id", F.posexplode(replies.items(F.col("reply"))).alias("pred_index", "i"))
    return rows.select("doc_id", "pred_index", "i.*")


def review_status(replied: DataFrame) -> DataFrame:
    """doc_id and whether the reply counts; a failed call and a literal null do not."""
    return replied.select("doc_id", (~F.col("failed") & ~replies.is_skipped(F.col("reply"))).alias("reviewed"))


def term_findings(s: DataFrame) -> DataFrame:
    terms = rules.term_entries(s)
    unused = rules.unused_terms(rules.term_usage(terms, s)).select("doc_id", "error_type", "dimension", "section_number", F.col("term").alias("name"), "confidence")
    gaps = rules.number_gaps(terms).select("doc_id", "error_type", "dimension", "section_number", F.col("missing").alias("name"), "confidence")
    return unused.unionByName(gaps)


def _worded(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "error_type", "dimension", "section_number", F.concat_ws(" ", "error_type", "name").alias("reason"), F.concat_ws(" ", "error_type", "name").alias("error_description"))


#: Reviewers that need no model.
RULE_REVIEWERS: dict[str, Reviewer] = {"term_index": lambda s: _worded(term_findings(s)), "reference_rules": lambda s: _worded(rules.reference_findings(s))}


class ReviewerBase:
    """A reviewer with a name: subclasses give review(sections) -> findings; reviewed() also counts its issues by type."""

    reviewer_id = ""

    def review(self, sections_: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, sections_: DataFrame) -> DataFrame:
        return self.review(sections_)

    def reviewed(self, sections_: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = self.review(sections_).withColumn("reviewer_id", F.lit(self.reviewer_id))
        return found, issue_summary(found.withColumn("issue_type", F.col("error_type")))


def high_recall(docs: DataFrame, streams: dict[str, DataFrame], reviewers: list[str] | None = None) -> DataFrame:
    """Final candidates of documents: given streams of findings and those of the rule reviewers, spread and deduplicated.

    Streams come first in their order, then reviewers in theirs; the first of equal keys stays.
    """
    s = sections.parse_sections(docs)
    wanted = RULE_REVIEWERS if reviewers is None else {k: RULE_REVIEWERS[k] for k in reviewers}
    every = {**streams, **{k: f(s) for k, f in wanted.items()}}
    if not every:
        raise ValueError("a review needs a stream or a reviewer")
    found = candidates.union_streams(every)
    order = ["src_rank", *(c for c in ("pred_index",) if c in found.columns), "section_number", "reason"]
    return candidates.output_columns(candidates.final_candidates(found, s, order), "doc_id", "source_agent")


# Rule tools, by name, on JSON

#: What each tool tells.
TOOL_TEXTS = {"check_mandatory_sections": "缺少的必备章节", "check_section_order": "编号和标准章节的次序", "check_section_names": "标准章节的不规范标题", "check_appendix_types": "附录的性质标注", "check_section_depth": "超过层次上限的编号"}


def tool_schemas(dimension: str) -> list[dict]:
    """The tools that a dimension's reviewer may call, as function schemas; only the structure has any."""
    if dimension != "C2.1":
        return []
    text = {"type": "object", "properties": {"source_text": {"type": "string"}}, "required": ["source_text"]}
    return [{"type": "function", "function": {"name": name, "description": TOOL_TEXTS[name], "parameters": text}} for name in STRUCTURE_TOOLS]


# Names of the tools that a structure review may call.
STRUCTURE_TOOLS = ["check_mandatory_sections", "check_section_order", "check_section_names", "check_appendix_types", "check_section_depth"]


def tool_findings(docs: DataFrame) -> DataFrame:
    """Results of all structure tools: doc_id, tool, result (JSON)."""
    h = sections.tool_headings(docs)
    found = [rules.missing_sections(docs, h), rules.order_issues(h), rules.name_issues(h), rules.appendix_types(h), rules.depth_issues(h)]
    parts = [docs.select("doc_id").join(df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "doc_id"]))).alias("r")), "doc_id", "left").select("doc_id", F.lit(name).alias("tool"), F.coalesce(F.to_json("r"), F.lit("[]")).alias("result")) for name, df in zip(STRUCTURE_TOOLS, found, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def call_tool(spark: SparkSession, name: str, arguments: str) -> str:
    """The result of one tool on {"source_text": ...} as JSON; errors are a JSON answer too."""
    try:
        if name not in STRUCTURE_TOOLS:
            raise KeyError(name)
        docs = spark.createDataFrame([("d", json.loads(arguments)["source_text"])], "doc_id string, source_text string")
        return tool_findings(docs).where(F.col("tool") == name).first()["result"]
    except Exception as e:  # noqa: BLE001  a tool's caller reads its error
        return json.dumps({"error": f"{type(e).__name__}: {e}"}, ensure_ascii=False)


def register_functions(spark: SparkSession) -> list[str]:
    """SQL functions of the text rules, as SQL expressions where one is enough."""
    names = []
    ws = r"[\\s\\x{3000}\\x{00A0}]"
    for name, body in {
        "review_reference_base": "CREATE OR REPLACE TEMPORARY FUNCTION review_reference_base(ref STRING) RETURNS STRING RETURN regexp_replace(ref, '-[0-9]{4}$', '')",
        "review_section_depth": "CREATE OR REPLACE TEMPORARY FUNCTION review_section_depth(n STRING) RETURNS INT RETURN CASE WHEN n RLIKE '^[0-9.]+' THEN length(n) - length(replace(n, '.', '')) + 1 END",
        "review_same_text": f"CREATE OR REPLACE TEMPORARY FUNCTION review_same_text(a STRING, b STRING) RETURNS BOOLEAN RETURN regexp_replace(a, '{ws}+', '') <> '' AND regexp_replace(a, '{ws}+', '') = regexp_replace(b, '{ws}+', '')",
    }.items():
        spark.sql(body)
        names.append(name)
    return names
