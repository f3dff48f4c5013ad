"""Queries of sources, sinks, replies, lookups and model steps over whole tables, each with its SQL.

The standards of corpus_queries are the documents; orders and their lines are benchmark records and their examples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import replies, text
from lectern.operators import allocation, candidates, injectors, matching, retrieval, review, rules, sections
from lectern.operators.storage import scratch, stored
from lectern.plans.corpus_queries import _S, parsed, standards
from lectern.plans.table_queries import ORACLES, QUERIES, query, read
from lectern.sources import benchmark, files
from lectern.streaming import leaderboard
from lectern.taxonomy import RISKY_MODALS

__all__ = ["ORACLES", "QUERIES"]


@query(f"WITH {_S} SELECT doc_id, section_number AS section, arg_min(title, ord) AS first_title, arg_max(title, ord) AS last_title FROM s GROUP BY 1, 2")
def jn5_section_titles(spark, sf_dir):
    """JN5, JN6: first and last section of each key, in all documents."""
    s = parsed(spark, sf_dir)
    first, last = (matching.section_lookup(s, x).select("doc_id", "section", F.col("title").alias(n)) for x, n in ((False, "first_title"), (True, "last_title")))
    return first.join(last, ["doc_id", "section"])


@query(rf"""WITH {_S}, y AS (SELECT *, regexp_full_match(section_number || '.1', '\d{{1,2}}(\.\d{{1,2}})+') AS cut FROM s),
    n AS (SELECT doc_id, ord, 0 AS sub, section_number, title, CASE WHEN cut THEN content ELSE ltrim(content || chr(10), chr(10)) || section_number || '.1 细则' || chr(10) || '甲' || ord END AS content FROM y UNION ALL SELECT doc_id, ord, 1, section_number || '.1', '细则', '甲' || ord FROM y WHERE cut)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord, sub) - 1)::INT AS ord, section_number, title, content FROM n""")
def wn9_nested_sections(spark, sf_dir):
    """WN9: a subsection within each section's content cut out; the other numbers there stay text."""
    s = parsed(spark, sf_dir)
    inner = F.concat_ws("\n", F.nullif("content", F.lit("")), F.concat(F.col("section_number"), F.lit(".1 细则")), F.concat(F.lit("甲"), F.col("ord").cast("string")))
    made = sections.split_nested(s.withColumn("content", inner))
    return made.withColumn("ord", F.col("ord").cast("int"))


@query(f"WITH {_S} SELECT doc_id, ord, section_number, title, CASE WHEN ord % 3 = 2 AND ord < max(ord) OVER (PARTITION BY doc_id) THEN content || chr(10) || '续' ELSE content END AS content FROM s")
def wn8_continued_sections(spark, sf_dir):
    """WN8, IO11: chunks of three sections, of which each repeats the one before its first with what goes on there."""
    s = parsed(spark, sf_dir).withColumn("chunk", F.floor(F.col("ord") / 3).cast("int"))
    last = s.groupBy("doc_id").agg(F.max("ord").alias("end"))
    again = s.join(last, "doc_id").where("ord % 3 = 2 and ord < end").select("doc_id", (F.col("chunk") + 1).alias("chunk"), F.lit(-1).alias("ord"), "section_number", "title", F.lit("续").alias("content"))
    return sections.continued(s.select(again.columns).unionByName(again)).select("doc_id", F.col("ord").cast("int").alias("ord"), "section_number", "title", "content")


_FORMS = "CASE p % 5 WHEN 0 THEN concat(' ', length(line)) WHEN 1 THEN concat('  正文', {own}, ' ') WHEN 2 THEN concat('GB/T ', length(line), '—2020') WHEN 3 THEN concat(length(line) % 9 + 1, '.', {nl}, length(line) % 7 + 1, ' 要求') ELSE '' END"


@query(rf"""WITH {_S}, x AS (SELECT doc_id, p, CASE p % 5 WHEN 1 THEN trim('正文' || regexp_replace(m.line, '[^\p{{Ll}} ]', '', 'g')) WHEN 3 THEN (n % 9 + 1) || '.' || (n % 7 + 1) || ' 要求' WHEN 0 THEN CASE WHEN n > 9999 THEN n::VARCHAR END END AS line FROM m)
    SELECT d.doc_id, coalesce(y.clean, '') AS clean FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS clean FROM x WHERE line IS NOT NULL GROUP BY 1) y ON d.doc_id = y.doc_id""")
def fs12_preprocessed_texts(spark, sf_dir):
    """FS11, FS12, PF13: numbers that a line end broke repaired, lines trimmed, page furniture dropped, in all documents."""
    form = _FORMS.format(own=r"regexp_replace(line, '[^\\p{Ll} ]', '')", nl="'\\n'")
    made = read(spark, sf_dir, "documents").select("doc_id", F.expr(f"array_join(transform(split(coalesce(text, ''), '\\n'), (line, p) -> {form}), '\\n')").alias("t"))
    return made.select("doc_id", sections.preprocessed(F.col("t")).alias("clean"))


@query(f"""WITH {_S} SELECT doc_id, p, p % 7 IN (5, 6) AS noise, CASE p % 7 WHEN 0 THEN 'numbered' WHEN 1 THEN 'appendix' WHEN 2 THEN 'markdown' WHEN 3 THEN 'bracket' WHEN 4 THEN 'plain' END AS kind FROM m WHERE n < 10000""")
def fs13_line_kinds(spark, sf_dir):
    """PF13, FS13: page furniture and kinds of headings among all lines."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "text")).where(F.length("text") < 10000)
    own = F.regexp_replace(F.substring("text", 1, 20), r"[^\p{Ll} ]", "")
    forms = [F.concat((F.length("text") % 9 + 1).cast("string"), F.lit(".1 要求")), F.concat(F.lit("附 录 A "), own), F.concat(F.lit("## 甲"), own), F.concat(F.lit("[1] "), own), F.lit("前 言"), F.length("text").cast("string"), F.lit(" ")]
    line = F.get(F.array(*forms), F.col("p") % 7)
    return lines.select("doc_id", F.col("p").cast("bigint").alias("p"), sections.is_noise(line).alias("noise"), F.when(~sections.is_noise(line), sections.heading_kind(line)).alias("kind"))


@query(f"WITH {_S} SELECT doc_id, '|' || string_agg(line, '|' ORDER BY p) AS parts FROM c WHERE kind = 1 GROUP BY doc_id, ord")
def fs15_listed_lines(spark, sf_dir):
    """FS15: the lines of all lists of references, with their introduction (empty here) first."""
    s = parsed(spark, sf_dir).where("title = '规范性引用文件' and content <> ''")
    return s.select("doc_id", F.array_join(injectors.reference_lines(F.col("content")), "|").alias("parts"))


@query(rf"WITH {_S} SELECT doc_id, ord, '审查维度：C3.1' || chr(10) || '待审查文档片段：' || (trim(regexp_replace(content, '\s+', ' ', 'g')))[:5000] AS query FROM s")
def fs22_query_texts(spark, sf_dir):
    """FS22: the texts by which rules are looked up for all sections."""
    return parsed(spark, sf_dir).select("doc_id", "ord", retrieval.query_text(F.col("content"), "C3.1").alias("query"))


@query(f"""WITH {_S}, f AS (SELECT *, '[' || section_number || '] ' || title || chr(10) || (trim(regexp_replace(content, '\\s+', ' ', 'g')))[:900] AS line, regexp_matches(content, '{"|".join(RISKY_MODALS)}') AS high FROM s)
    SELECT doc_id, ('【全文章节目录】' || chr(10) || coalesce(string_agg('[' || section_number || '] ' || title, chr(10) ORDER BY ord) FILTER (ord < 240), '')
      || chr(10) || chr(10) || '【C3.1 高风险语气候选章节：含必须/须/宜/可/不应/不宜/模糊语气词等】' || chr(10) || coalesce(string_agg(line, chr(10) || chr(10) ORDER BY ord) FILTER (high), '（未检出高风险语气候选章节）')
      || chr(10) || chr(10) || '【C3.1 普通“应”候选章节：优先级较低，仅用于补充核对】' || chr(10) || coalesce(string_agg(line, chr(10) || chr(10) ORDER BY ord) FILTER (NOT high AND contains(content, '应')), '（未检出仅含普通“应”的候选章节）'))[:18000] AS context FROM f GROUP BY 1""")
def lm12_modal_contexts(spark, sf_dir):
    """LM12, PF9: the contexts of a modal review of all documents."""
    return rules.modal_context(parsed(spark, sf_dir))


# Items and replies

_ITEMS = """i AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN ' ' ELSE l_returnflag || ' ' END AS dimension, CASE l_partkey % 5 WHEN 0 THEN NULL ELSE ' ' || l_linestatus END AS error_type,
    CASE WHEN l_partkey % 3 = 0 THEN '  ' ELSE 'r' || l_suppkey END AS reason, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'e' || l_suppkey || chr(10) END AS error_description FROM lineitem)"""


@query(f"""WITH {_ITEMS}, k AS (SELECT doc_id, trim(dimension) AS dimension, trim(error_type) AS error_type, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber::VARCHAR END AS section_number, nullif(trim(reason), '') AS r, nullif(trim(error_description, ' ' || chr(10)), '') AS e
      FROM i WHERE trim(dimension) <> '' AND error_type IS NOT NULL)
    SELECT doc_id, dimension, error_type, section_number, coalesce(r, e, '') AS reason, coalesce(e, r, '') AS error_description FROM k""")
def pf2_normalised_lines(spark, sf_dir):
    """PF2 to PF4: items trimmed, incomplete ones dropped, reason and description standing in for one another."""
    made = """l_orderkey AS doc_id, CASE l_partkey % 4 WHEN 0 THEN ' ' ELSE l_returnflag || ' ' END AS dimension, CASE l_partkey % 5 WHEN 0 THEN NULL ELSE ' ' || l_linestatus END AS error_type, CASE WHEN l_linenumber = 7 THEN ' ' ELSE ' ' || l_linenumber END AS section_number,
        CASE WHEN l_partkey % 3 = 0 THEN '  ' ELSE 'r' || l_suppkey END AS reason, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'e' || l_suppkey || '\\n' END AS error_description"""
    items = read(spark, sf_dir, "lineitem").select(*[F.expr(x) for x in _columns(made)])
    return candidates.output_columns(candidates.normalised(items), "doc_id")


def _columns(listed: str) -> list[str]:
    """Expressions of a select list without commas inside parentheses at their ends."""
    parts, depth = [""], 0
    for c in listed:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


@query("""WITH r AS (SELECT doc_id, doc_id % 5 AS kind, length(coalesce(text, '')) AS n FROM documents)
    SELECT doc_id, CASE kind WHEN 4 THEN NULL WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END::INT AS n, kind = 4 AS skipped, CASE WHEN kind IN (0, 1, 2) THEN 'E' || n END AS first FROM r""")
def fj2_reply_items(spark, sf_dir):
    """FJ1, FJ2: the items of replies that think aloud, fence, talk around, break off, or skip the document."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("string")
    one = F.concat(F.lit('{"error_type": "E'), n, F.lit('", "reason": "因"}'))
    forms = [F.concat(F.lit("<think>["), n, F.lit("]</think>["), one, F.lit(", 3, {}]")), F.concat(F.lit("说明\n```json\n["), one, F.lit(", {}, null]\n```")), F.concat(F.lit("结果 ["), one, F.lit(", \"x\"] 完")), F.concat(F.lit("["), one), F.lit(" null ")]
    reply = F.get(F.array(*forms), (F.col("doc_id") % 5).cast("int"))
    found = replies.items(reply)
    return read(spark, sf_dir, "documents").select("doc_id", F.when(found.isNotNull(), F.size(found)).alias("n"), replies.is_skipped(reply).alias("skipped"), F.get(found, F.lit(0))["error_type"].alias("first"))


@query(f"WITH {_S} SELECT doc_id, section_number, title, content FROM s")
def fj4_reply_sections(spark, sf_dir):
    """FJ3, FJ4: all sections as one JSON reply a document, with noise among them, and read again."""
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section_number", "title", "content"))), lambda x: F.struct(x["section_number"].alias("section_number"), x["title"].alias("title"), x["content"].alias("content"))))
    reply = F.concat(F.lit('好的：[{"title": " "}, 5, '), F.substr(listed, F.lit(2), F.length(listed)))
    made = parsed(spark, sf_dir).groupBy("doc_id").agg(reply.alias("reply"))
    return made.select("doc_id", F.explode(replies.section_rows(F.col("reply"))).alias("s")).select("doc_id", "s.*")


# Benchmark files

_SHARD = 200


def records(spark, sf_dir) -> DataFrame:
    """Orders as records of a construction: shard, place in it, file name, text, and an example for each line."""
    part = lambda x, c: F.struct(x["l_linenumber"].cast("string").alias("section_number"), F.concat(F.lit("甲"), x[c].cast("string")).alias("title"), F.lit("乙\t丙").alias("content"))
    example = lambda x: F.struct(x["l_returnflag"].alias("dimension"), F.nullif(x["l_linestatus"], F.lit("F")).alias("error_type"), part(x, "l_partkey").alias("original"), F.when(x["l_partkey"] % 4 != 0, part(x, "l_suppkey")).alias("corrupted"), F.lit("述").alias("error_description"))
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus"]  # these travel; examples are made of them where they arrive
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct(*columns).alias("line"), F.lit(None).cast("string").alias("priority"), F.lit(False).alias("own"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"), F.col("o_orderpriority").alias("priority"), F.lit(True).alias("own"))
    shard = F.floor(F.col("key") / _SHARD)
    dealt = orders.unionAll(lines).withColumn("shard", shard).repartition("shard")  # the only exchange: orders, their lines and the shard's file meet
    of = F.collect_list(F.when(F.col("own"), F.struct("priority")))
    listed = dealt.groupBy("shard", "key").agg(of.alias("orders"), F.transform(F.array_sort(F.collect_list("line")), example).alias("examples"))
    text = F.when(F.col("key") % 9 == 0, " ").otherwise(F.concat("o.priority", F.lit("\t文")))
    return listed.select("shard", "key", "examples", F.explode("orders").alias("o")).select("shard", (F.col("key") % _SHARD).cast("int").alias("pos"), F.concat(F.lit("o"), F.col("key").cast("string"), F.lit(".pdf")).alias("file_name"), text.alias("source_text"), "examples")


def _written(spark, sf_dir) -> str:
    """Benchmark files of _SHARD documents each, raw control characters within their strings."""
    path = scratch(spark, "benchmark")
    docs = F.array_sort(F.collect_list(F.struct("pos", "file_name", "source_text", "examples")))
    shards = records(spark, sf_dir).groupBy("shard").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total_files"), docs.alias("documents"))).alias("value"))
    shards.select("shard", F.replace("value", F.lit("\\t"), F.lit("\t")).alias("value")).write.partitionBy("shard").option("compression", "gzip").text(path)  # a row is a file
    return f"{path}/*/*"


_EXAMPLES = f"""x AS (SELECT 'o' || l_orderkey || '.pdf' AS file_name, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS gt_index, l_linenumber::VARCHAR AS section_number,
      l_returnflag AS dimension, CASE WHEN l_linestatus = 'F' THEN '' ELSE l_linestatus END AS error_type, '甲' || CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey ELSE l_partkey END AS title FROM lineitem),
    n AS (SELECT 'o' || o_orderkey || '.pdf' AS file_name, o_orderkey, (o_orderkey % {_SHARD})::INT AS pos, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INT AS n FROM orders)"""


@query(f"WITH {_EXAMPLES} SELECT file_name, pos, n FROM n")
def io1_benchmark_documents(spark, sf_dir):
    """IO1: documents of benchmark files, one shard of 200 orders a file."""
    return benchmark.read_benchmark(spark, _written(spark, sf_dir)).select("file_name", "pos", F.size("examples").alias("n"))


@query(f"WITH {_EXAMPLES} SELECT file_name FROM n WHERE pos < 3")
def io2_leading_documents(spark, sf_dir):
    """IO2: the first three documents of each file."""
    return benchmark.read_benchmark(spark, _written(spark, sf_dir), 3).select("file_name")


@query(f"WITH {_EXAMPLES} SELECT file_name, gt_index::INT AS gt_index, section_number, dimension, error_type, title FROM x WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0)")
def pf7_benchmark_items(spark, sf_dir):
    """PF7, PF8: the items of documents with text, at the corrupted section or the original one where it was deleted."""
    docs = benchmark.read_benchmark(spark, _written(spark, sf_dir)).withColumn("doc_id", F.col("file_name"))
    kept = benchmark.scored_documents(docs, docs.select("doc_id", F.lit(True).alias("reviewed")))
    return benchmark.ground_truth(kept).select(F.col("doc_id").alias("file_name"), "gt_index", "section_number", "dimension", "error_type", "title")


@query(f"WITH {_EXAMPLES} SELECT file_name, (row_number() OVER (ORDER BY o_orderkey))::INT AS record_index, n AS example_count FROM n")
def io6_numbered_records(spark, sf_dir):
    """IO6: records numbered in order over all shards, with their number of examples."""
    made = records(spark, sf_dir).select("file_name", (F.col("shard") * _SHARD + F.col("pos")).alias("pos"), F.transform("examples", lambda e: e["error_type"]).alias("examples"))  # what is not asked for is not carried through the numbering
    return benchmark.with_stats(made).select("file_name", "record_index", "example_count")


@query(f"""WITH {_EXAMPLES} SELECT (SELECT count(*) FROM n) AS total_files, (SELECT count(*) FROM x) AS total_examples,
    (SELECT string_agg(k || '=' || c, ',' ORDER BY k) FROM (SELECT coalesce(nullif(error_type, ''), 'UNKNOWN') AS k, count(*) AS c FROM x GROUP BY 1)) AS kinds""")
def io5_record_totals(spark, sf_dir):
    """IO4, IO5, AG14: the totals of a construction, written and read back."""
    path = scratch(spark, "construction")
    benchmark.write_summary(benchmark.construction_totals(records(spark, sf_dir)).withColumn("kinds", F.array_join(F.transform(F.map_entries("error_type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")), path)
    return spark.read.json(path).select("total_files", "total_examples", "kinds")


@query(f"WITH {_S} SELECT d.doc_id, count(s.ord)::INT AS section_count FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1")
def io7_text_records(spark, sf_dir):
    """IO7: texts with their number of sections."""
    docs = stored(standards(spark, sf_dir), "standards")
    return benchmark.source_records(sections.parse_sections(docs), docs).select("doc_id", "section_count")


@query("SELECT user_id % 4 AS batch, event_id, value AS hits FROM events")
def io3_record_batches(spark, sf_dir):
    """IO3: records flushed batch by batch, of which one comes again and replaces itself."""
    path, e = scratch(spark, "records"), read(spark, sf_dir, "events").select("event_id", F.col("value").alias("hits"), (F.col("user_id") % 4).alias("batch"))
    write = benchmark.record_sink(path)
    for batch, factor in ((0, 1), (1, 9), (2, 1), (3, 1), (1, 1)):
        write(e.where(F.col("batch") == batch).select("event_id", (F.col("hits") * factor).alias("hits")), batch)
    return spark.read.schema("event_id bigint, hits double, batch bigint").json(path).select("batch", "event_id", "hits")


@query(f"""WITH {_S}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM s WHERE title = '标志')
    SELECT doc_id, '# 反例标注清单' || chr(10) || chr(10) || string_agg('## [' || i || '] 维度: C2.1  错误类型: E-S-02' || chr(10) || '位置: [' || section_number || '] 标志' || chr(10) || '说明: ' || content || chr(10), chr(10) ORDER BY i) AS annotation FROM a GROUP BY 1""")
def io21_annotation_texts(spark, sf_dir):
    """IO21: the annotations of each document as text."""
    a = parsed(spark, sf_dir).where("title = '标志'").select("doc_id", "ord", F.lit("C2.1").alias("dimension"), F.lit("E-S-02").alias("error_type"), F.struct("section_number", "title", "content").alias("original"), F.col("content").alias("error_description"))
    return benchmark.annotation_text(a)


@query(f"WITH {_S} SELECT doc_id, ord, section_number, CASE WHEN ord % 5 = 1 THEN '换' ELSE title END AS title, CASE WHEN ord % 5 = 1 THEN '新' ELSE content END AS content FROM s WHERE ord % 5 <> 0")
def io22_merged_documents(spark, sf_dir):
    """IO22: corrupted sections in place of the originals, some of them deleted, in all documents."""
    s = stored(parsed(spark, sf_dir), "sections")
    new = F.when(F.col("ord") % 5 == 1, F.struct("section_number", F.lit("换").alias("title"), F.lit("新").alias("content")))
    return injectors.merged_sections(s, s.where("ord % 5 < 2").select("doc_id", "ord", new.alias("corrupted")))


@query(f"WITH {_S} SELECT d.doc_id, NOT coalesce(regexp_matches(string_agg(s.title || s.content, ' '), '{'|'.join(files.READABLE)}'), false) AS garbled FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1")
def pf14_garbled_texts(spark, sf_dir):
    """PF14: texts without any of the expected words."""
    return standards(spark, sf_dir).select("doc_id", files.is_garbled(F.col("source_text")).alias("garbled"))


@query("SELECT doc_id, 'true' AS within_range FROM documents")
def ce29_document_targets(spark, sf_dir):
    """CE29: 0 to 3 more than the base for each document."""
    return read(spark, sf_dir, "documents").select("doc_id", allocation.target_count(F.col("doc_id"), 5, 7).between(5, 8).cast("string").alias("within_range"))


@query(f"""WITH {_S}, b AS (SELECT *, sum((NOT contains(section_number, '.'))::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS block FROM s), k AS (SELECT doc_id, block FROM b WHERE block > 0 GROUP BY 1, 2 HAVING bool_or(content <> ''))
    SELECT DISTINCT 'E-S-01' AS error_type, doc_id FROM s WHERE regexp_matches(title, '前言|规范性引用文件|术语|要求|性能|规范|指标|试验|检验|检测') UNION ALL SELECT 'E-S-02', doc_id FROM k GROUP BY 2 HAVING count(*) >= 2""")
def ce1_restructured_documents(spark, sf_dir):
    """CE1, CE2, JN17, WN10: the documents that lose a mandatory section, or in which two blocks change places."""
    s = stored(parsed(spark, sf_dir), "sections")
    return reduce(DataFrame.unionByName, [injectors.INJECTORS[t](s, 7).annotations.select(F.lit(t).alias("error_type"), "doc_id").distinct() for t in ("E-S-01", "E-S-02")])


# Models and streams


def _stub(prompt: str) -> str:
    """A model of a rule's size: counts the places of 应 and fails on texts that lack the word 术语."""
    if "术语" not in prompt:
        raise TimeoutError
    return f'[{{"error_type": "E-T-01", "dimension": "C3.1", "section_number": "{prompt.count("应")}", "reason": "r"}}]'


@query(f"""WITH {_S}, d AS (SELECT doc_id, string_agg('[' || section_number || '] ' || title || chr(10) || content, chr(10) ORDER BY ord) AS t FROM s GROUP BY 1)
    SELECT d.doc_id, CASE WHEN contains(t, '术语') THEN (length(t) - length(replace(t, '应', '')))::VARCHAR END AS section_number, NOT contains(t, '术语') AS failed FROM d""")
def lm10_answered_documents(spark, sf_dir):
    """LM1, LM10, UD6: every document asked of a client with replies stored by the digest of their prompt; failed calls have none."""
    asks = standards(spark, sf_dir).select("doc_id", F.col("source_text").alias("prompt"))
    said = review.asked_once(asks, _stub, scratch(spark, "replies"), tries=1)
    return said.select("doc_id", F.get(replies.items(F.col("reply")), F.lit(0))["section_number"].alias("section_number"), "failed")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ag7_streamed_windows(spark, sf_dir):
    """AG7, IO3: events as a stream of all files that are there, counted by window under a watermark, each batch's counts written under its id."""
    source = read(spark, sf_dir, "events").withColumn("ts", F.expr("CAST(convert_timezone('UTC', current_timezone(), ts) AS TIMESTAMP)"))
    path, out, state = (scratch(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    source.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
    leaderboard.windowed_updates(stream, "ts", "6 hours", "400 days", "event_type", out, state).awaitTermination()
    utc = F.expr("convert_timezone(current_timezone(), 'UTC', CAST(start AS TIMESTAMP_NTZ))")
    return leaderboard.latest_windows(spark, out, "event_type").withColumn("start", utc)


@query(f"WITH {_S} SELECT doc_id, count(*) AS sections, sum(length(content))::BIGINT AS chars FROM s GROUP BY 1")
def ag7_streamed_sections(spark, sf_dir):
    """UD5, IO8, AG7: sections as a stream of the Python data source, counted by document."""
    from lectern.sources import review_source

    review_source.register_sources(spark)
    path, out, state = (scratch(spark, x) for x in ("texts", "stream-out", "stream-state"))
    benchmark.write_texts(standards(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "source_text").repartition(4), path)
    spark.readStream.format("review_sections").load(path).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.schema("doc_id string, ord int, section_number string, title string, content string").parquet(out)
    return got.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("content")).alias("chars"))
