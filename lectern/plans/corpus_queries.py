"""Queries of the rule checks over whole `documents`, each with its SQL.

A text becomes a standard in the reviewed language: every fourth line is a heading (number and title follow from its place),
the lines between are its content, worded by their kind and holding the letters of the original line. The input is
stated once for both engines; what the rules find in it is stated again in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import allocation, injectors, rules, sections, tables
from lectern.operators.storage import scratch, stored
from lectern.plans.table_queries import ORACLES, QUERIES, query, read
from lectern.sources import benchmark, review_source
from lectern.taxonomy import MODALS, RISKY_MODALS, TECHNICAL_TITLES, TECHNICAL_WORDS, TERM_WORDS, WRONG_TITLES

__all__ = ["ORACLES", "QUERIES"]

TITLES = ["范围", "规范性引用文件", "术语和定义", "技术要求", "试验方法", "适用范围", "检验规则", "附录A（规范性）", "附录B", "引用标准", "标志", "参考文献"]
#: Of line p of a document, in section k, with n code points and the letters own: its title, number and content, in SQL of either engine.
TITLE = "CASE (doc_id + {k}) % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES)) + " END"
NUMBER = "CASE WHEN {k} % 6 = 0 THEN concat('9.1.1.1.1.', {k}) WHEN {k} % 7 = 0 THEN concat('', {k} + 9) ELSE concat('', {k} + 10) END"
CONTENT = """CASE (doc_id + {k}) % 12 WHEN 1 THEN concat('GB/T ', {n} % 30 + 1, '—20', 10 + {n} % 3, ' 标准') WHEN 2 THEN concat('3.', {n} % 50 + 1, ' 术语', {n} % 60, '词 term')
    ELSE CASE {n} % 5 WHEN 0 THEN concat('产品', {own}, '应符合 GB/T ', {n} % 30 + 1, '—20', 10 + {n} % 4, ' 的规定。') WHEN 1 THEN concat('产品', {own}, '宜采用术语', {n} % 60, '词。')
    WHEN 2 THEN concat('产品', {own}, '不应超过限值；可按规定试验。') WHEN 3 THEN concat('一般情况下 ', {own}, '。') ELSE concat('容量为 ', {n}, ' 毫升') END END"""

_NAMES = {"k": "k", "n": "n", "own": "own"}
_S = rf"""l AS (SELECT doc_id, unnest(range(len(x))) AS p, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
    m AS (SELECT doc_id, p, line, length(line) AS n, regexp_replace(line, '[^\p{{L}} ]', '', 'g') AS own, p // 4 + 1 AS k FROM l),
    t AS (SELECT * EXCLUDE (line), {TITLE.format(**_NAMES)} AS title, {NUMBER.format(**_NAMES)} AS section_number FROM m),
    c AS (SELECT doc_id, k - 1 AS ord, p, n, title, section_number, (doc_id + k) % 12 AS kind, {CONTENT.format(**_NAMES)} AS line FROM t WHERE p % 4 > 0),
    s AS (SELECT h.doc_id, (h.k - 1)::INT AS ord, h.section_number, h.title, coalesce(string_agg(c.line, chr(10) ORDER BY c.p), '') AS content
          FROM (SELECT * FROM t WHERE p % 4 = 0) h LEFT JOIN c ON h.doc_id = c.doc_id AND h.k - 1 = c.ord GROUP BY ALL)"""


def standards(spark, sf_dir) -> DataFrame:
    """doc_id and source_text of each document as a standard."""
    names = {"k": "(p div 4 + 1)", "n": "length(line)", "own": r"regexp_replace(line, '[^\\p{L} ]', '')"}
    heading = f"concat('[', {NUMBER.format(**names)}, '] ', {TITLE.format(**names)})"
    made = f"array_join(transform(split(coalesce(text, ''), '\\n'), (line, p) -> CASE WHEN p % 4 = 0 THEN {heading} ELSE {CONTENT.format(**names)} END), '\\n')"
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(made).alias("source_text"))


def parsed(spark, sf_dir) -> DataFrame:
    return sections.parse_sections(standards(spark, sf_dir))


@query(f"WITH {_S} SELECT * FROM s")
def wn1_parsed_standards(spark, sf_dir):
    """WN1, FS13: texts cut at their headings, over all documents."""
    return parsed(spark, sf_dir)


@query(f"WITH {_S} SELECT doc_id, string_agg('[' || section_number || '] ' || title || chr(10) || CASE WHEN content <> '' THEN content || chr(10) ELSE '' END, chr(10) ORDER BY ord) AS source_text FROM s GROUP BY 1")
def io19_section_texts(spark, sf_dir):
    """IO19, PF17: sections as text again."""
    return sections.section_text(parsed(spark, sf_dir))


_REFS = """r AS (SELECT doc_id, ord, section_number, kind = 1 AS listed, 'GB/T' || (n % 30 + 1) AS base, 'GB/T' || (n % 30 + 1) || '-20' || CASE WHEN kind = 1 THEN 10 + n % 3 ELSE 10 + n % 4 END AS ref
        FROM c WHERE kind = 1 OR (kind NOT IN (2, 11) AND n % 5 = 0)),
    g AS (SELECT doc_id, base, ref, bool_or(listed) AS l, bool_or(NOT listed) AS b, arg_min(section_number, ord) FILTER (NOT listed) AS spot FROM r GROUP BY ALL),
    heads AS (SELECT doc_id, arg_min(section_number, ord) AS spot FROM s WHERE title = '规范性引用文件' GROUP BY 1),
    f AS (SELECT doc_id, 1 AS rule, 'E-R-01' AS error_type, ref AS name, spot AS section_number, 0.6 AS confidence FROM g WHERE b AND NOT l
        UNION ALL SELECT g.doc_id, 2, 'E-R-02', ref, heads.spot, 0.58 FROM g JOIN heads USING (doc_id) WHERE l AND NOT b
        UNION ALL SELECT doc_id, 3, 'E-R-03', base, arg_min(spot, ref) FILTER (b), 0.52 FROM g GROUP BY doc_id, base HAVING bool_or(l) AND bool_or(b) AND NOT bool_or(l AND b))"""


@query(f"WITH {_S}, {_REFS} SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule, name)::INT AS rank, error_type, section_number, name, confidence::DOUBLE AS confidence FROM f) WHERE rank <= 80")
def tk4_standard_references(spark, sf_dir):
    """JN8 to JN10, AG18, ST7, TK4, FS2 to FS4: missing, redundant and mismatched references of all documents, in order."""
    return rules.reference_findings(parsed(spark, sf_dir)).select("doc_id", "rank", "error_type", "section_number", "name", "confidence")


_SENTENCES = rf"""u AS (SELECT doc_id, ord, section_number, unnest(range(len(x))) AS pos, trim(regexp_replace(unnest(x), '\s+', ' ', 'g')) AS sentence FROM (SELECT *, regexp_split_to_array(content, '[。；;！？!?\n]+') AS x FROM s)),
    w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_number, sentence ORDER BY ord, pos) AS nth FROM u WHERE length(sentence) >= 6 AND regexp_matches(sentence, '{"|".join(MODALS)}')),
    v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, pos) AS rank FROM w WHERE nth = 1)"""


@query(f"""WITH {_S}, {_SENTENCES} SELECT doc_id, rank::INT AS rank, section_number, sentence[:360] AS sentence, array_to_string([x for x in {MODALS!r} if contains(sentence, x)], ',') AS modal_words, ((rank - 1) // 70)::INT AS batch
    FROM v WHERE rank <= 220""")
def wn3_standard_sentences(spark, sf_dir):
    """WN3, WN14, FS6, FS7: the sentences with modal words of all documents, each once a section."""
    return rules.modal_sentences(parsed(spark, sf_dir)).select("doc_id", "rank", "section_number", "sentence", F.array_join("modal_words", ",").alias("modal_words"), "batch")


_TERMS = """e AS (SELECT doc_id, ord, p, '术语' || (n % 60) || '词' AS term, '3.' || (n % 50 + 1) AS section_number FROM c WHERE kind = 2),
    o AS (SELECT doc_id, term, arg_min(section_number, struct_pack(ord, p)) AS section_number, min(struct_pack(ord, p)) AS spot FROM e GROUP BY 1, 2),
    terms AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS rank, term, section_number FROM o)"""


@query(f"WITH {_S}, {_TERMS} SELECT doc_id, rank::INT AS rank, term, section_number FROM terms WHERE rank <= 120")
def fs9_standard_terms(spark, sf_dir):
    """WN4, FS8, FS9, PF12: term lines of all documents, each term where it stands first."""
    return rules.term_entries(parsed(spark, sf_dir)).select("doc_id", "rank", "term", "section_number")


_USES = "x AS (SELECT DISTINCT doc_id, ord, section_number, '术语' || (n % 60) || '词' AS term FROM c WHERE kind NOT IN (1, 2) AND n % 5 = 1)"


@query(f"""WITH {_S}, {_TERMS}, {_USES} SELECT doc_id, terms.rank::INT AS rank, term, count(x.ord) AS used_count, array_to_string((list(x.section_number ORDER BY x.ord) FILTER (x.ord IS NOT NULL))[1:12], ',') AS used_sections
    FROM terms LEFT JOIN x USING (doc_id, term) WHERE terms.rank <= 120 GROUP BY ALL""")
def ag21_standard_usage(spark, sf_dir):
    """JN11, AG21, TK8: the sections of all documents that use their terms, the first twelve by number."""
    s = parsed(spark, sf_dir)
    used = rules.term_usage(rules.term_entries(s), s)
    return used.select("doc_id", "rank", "term", "used_count", F.nullif(F.array_join("used_sections", ","), F.lit("")).alias("used_sections"))


@query(f"""WITH {_S}, {_TERMS}, {_USES}, n AS (SELECT t.*, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.rank) AS k FROM terms t ANTI JOIN x USING (doc_id, term)),
    h AS (SELECT doc_id, list(DISTINCT split_part(section_number, '.', 2)::INT) AS have FROM terms GROUP BY 1), q AS (SELECT doc_id, [i for i in range(list_min(have), list_max(have) + 1) if NOT list_contains(have, i::INT)] AS gaps FROM h)
    SELECT doc_id, 'E-TM-02' AS error_type, section_number, term AS what FROM n WHERE k <= 30
    UNION ALL SELECT doc_id, 'E-TM-05', '3', array_to_string(['3.' || i for i in gaps[1:8]], ', ') FROM q WHERE len(gaps) > 0""")
def tk9_standard_terms(spark, sf_dir):
    """TK9, WN6: terms without use and gaps in their numbers, in all documents."""
    s = parsed(spark, sf_dir)
    terms = rules.term_entries(s)
    unused = rules.unused_terms(rules.term_usage(terms, s)).select("doc_id", "error_type", "section_number", F.col("term").alias("what"))
    return unused.union(rules.number_gaps(terms).select("doc_id", "error_type", "section_number", "missing"))


@query(f"WITH {_S}, {_TERMS} SELECT doc_id, '3.' || (split_part(arg_max(section_number, rank), '.', 2)::INT + 1) AS next_number FROM terms GROUP BY 1")
def wn11_standard_numbers(spark, sf_dir):
    """WN11: the number after the last term of each document."""
    return rules.next_number(rules.term_entries(parsed(spark, sf_dir)))


_WRONG = ", ".join(f"('{w}', '{right}')" for right, words in WRONG_TITLES.items() for w in words)
_ORDER = """top AS (SELECT doc_id, ord, section_number::INT AS number, title FROM s WHERE regexp_full_match(section_number, '[0-9]+')),
    steps AS (SELECT *, lag(number) OVER w AS before, lag(title) OVER w AS old FROM top WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    ends AS (SELECT doc_id, arg_max(number, ord) FILTER (contains(title, '范围')) AS a, arg_max(number, ord) FILTER (contains(title, '规范性引用文件')) AS b, arg_max(number, ord) FILTER (contains(title, '术语和定义')) AS c FROM top GROUP BY 1)"""


@query(f"""WITH {_S}, {_ORDER} SELECT doc_id, 'missing' AS finding, category AS what FROM (SELECT d.doc_id, x.category FROM documents d CROSS JOIN (VALUES ('前言', '前言'), ('范围', '范围'), ('规范性引用文件', '规范性引用文件'), ('术语和定义', '术语')) x(category, word)
        WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND contains(s.title, x.word)))
    UNION ALL SELECT doc_id, 'order', before || ' ' || old || ' > ' || number || ' ' || title FROM steps WHERE number <= before
    UNION ALL SELECT doc_id, 'standard', a || ' 范围 > ' || b || ' 规范性引用文件' FROM ends WHERE a > b UNION ALL SELECT doc_id, 'standard', b || ' 规范性引用文件 > ' || c || ' 术语和定义' FROM ends WHERE b > c
    UNION ALL SELECT doc_id, 'name', s.title || ' > ' || y.right_ FROM s JOIN (VALUES {_WRONG}) y(title, right_) USING (title)
    UNION ALL SELECT doc_id, 'depth', section_number FROM s WHERE section_number LIKE '9.%'
    UNION ALL SELECT doc_id, 'appendix', section_number || ' 规范性' FROM s WHERE title = '附录A（规范性）'""")
def jn15_standard_structure(spark, sf_dir):
    """JN15, JN16, WN5, FS18 to FS20, PF16: what the structure tools find in all documents."""
    docs = standards(spark, sf_dir)
    h = sections.tool_headings(docs)
    issues = rules.order_issues(h)
    row = lambda df, name, what: df.select("doc_id", F.lit(name).alias("finding"), what.alias("what"))
    steps = F.concat("prev", F.lit(" > "), "curr")
    parts = [
        row(rules.missing_sections(docs, h), "missing", F.col("category")), row(issues.where("kind = 'sequence'"), "order", steps), row(issues.where("kind = 'standard'"), "standard", steps),
        row(rules.name_issues(h), "name", F.concat("title", F.lit(" > "), "standard_title")), row(rules.depth_issues(h), "depth", F.col("section_number")), row(rules.appendix_types(h), "appendix", F.concat("section_number", F.lit(" "), "attribute")),
    ]
    return reduce(DataFrame.union, parts)


_has = lambda c, words: f"regexp_matches({c}, '{'|'.join(words)}')"


@query(f"""WITH {_S} SELECT doc_id, ord, CASE WHEN {_has("content", RISKY_MODALS)} THEN 'high' WHEN contains(content, '应') THEN 'ordinary' END AS modal,
    CASE WHEN title = '术语和定义' THEN 'term' WHEN {_has("title", TECHNICAL_TITLES)} THEN 'title' WHEN {_has("title || chr(10) || content", TECHNICAL_WORDS + TERM_WORDS)} THEN 'keyword' END AS technical,
    NOT contains(section_number, '.') AS top, trim(content) <> '' AS has_text FROM s""")
def pf9_section_classes(spark, sf_dir):
    """PF9, PF10, PF12, PF15, PF16: the classes of all sections."""
    s, number, content = parsed(spark, sf_dir), F.col("section_number"), F.col("content")
    return s.select("doc_id", "ord", rules.modal_class(content).alias("modal"), rules.technical_class(number, F.col("title"), content).alias("technical"), sections.is_top_level(number).alias("top"), sections.has_text(content).alias("has_text"))


@query(f"""WITH {_S}, d AS (SELECT *, length(section_number) - length(replace(section_number, '.', '')) AS dots, sum((contains(title, '术语') OR contains(title, '定义') OR section_number LIKE '3%')::INT) OVER (PARTITION BY doc_id) AS terms FROM s),
    p AS (SELECT doc_id, unnest(['C2.1', 'C2.2', 'C3.1', 'C3.2', 'C3.3']) AS dimension, unnest([(regexp_matches(title, '前言|引言|附录|范围|规范性引用文件|术语') OR dots >= 4)::INT,
        (regexp_matches(title, '范围|试验|要求|判定|方法|报告') OR list_contains(['1', '4', '5', '6', '7', '8', '9'], split_part(section_number, '.', 1)))::INT, regexp_matches(content, '应|宜|可|须|尽量|最好|一般')::INT,
        (contains(title, '术语') OR contains(title, '定义') OR section_number LIKE '3%')::INT + (terms < 8 AND ord < 20)::INT, (title = '规范性引用文件' OR contains(content, 'GB/T'))::INT]) AS n FROM d)
    SELECT doc_id, dimension, sum(n)::BIGINT AS lines FROM p GROUP BY 1, 2 HAVING sum(n) > 0""")
def pf11_standard_focus(spark, sf_dir):
    """PF11: how many lines of each document each dimension's review looks at."""
    s = parsed(spark, sf_dir)
    parts = [rules.focus(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines")).select("doc_id", F.lit(d).alias("dimension"), "lines") for d in ("C2.1", "C2.2", "C3.1", "C3.2", "C3.3")]
    return reduce(DataFrame.unionByName, parts)


@query(rf"""WITH {_S}, k AS (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS flat FROM s)
    SELECT doc_id, ord, '[' || section_number || '] ' || title AS label, '[' || section_number || '] ' || title || chr(10) || flat[:260] AS line, CASE WHEN flat = '' THEN '（空）' WHEN length(flat) > 120 THEN rtrim(flat[:120]) || '...' ELSE flat END AS brief,
    CASE WHEN section_number LIKE '9.%' THEN 6 ELSE 1 END AS depth, CASE WHEN length(title) <= 8 THEN repeat('*', length(title)) ELSE title[:4] || '...' || title[-4:] END AS masked, section_number AS key FROM k""")
def fs10_section_texts(spark, sf_dir):
    """PF1, PF17, FS1, FS10, FS18, FS23, TK8: short forms of all sections."""
    s, number, title, content = parsed(spark, sf_dir), F.col("section_number"), F.col("title"), F.col("content")
    return s.select("doc_id", "ord", text.label(number, title).alias("label"), text.section_line(number, title, content).alias("line"), text.brief(content).alias("brief"), text.depth(number).alias("depth"), text.masked(title).alias("masked"), text.section_key(F.concat(F.lit(" ["), number, F.lit("] "))).alias("key"))


@query(rf"""WITH {_S}, d AS (SELECT *, instr(content, '应') AS spot FROM s)
    SELECT doc_id, ord, CASE WHEN spot > 0 THEN content[:spot - 1] || '宜' || content[spot + 1:] ELSE content END AS replaced, CASE WHEN contains(content, '限值') THEN content WHEN content = '' THEN '限值' ELSE content || '（限值）' END AS noted,
    CASE WHEN contains(content, '限值') THEN content WHEN content = '' THEN '限值' ELSE content || '；补充：限值' END AS supplemented,
    array_to_string(list_transform(list_distinct([regexp_extract(x, 'GB/T \d+') for x in regexp_extract_all(content, 'GB/T \d+')]).list_sort(), lambda x: replace(x, ' ', '')), ',') AS ids, content <> '' AS same FROM d""")
def fs14_edited_texts(spark, sf_dir):
    """FS5, FS14, FS16, FS17: edits of all contents, the references that injectors see in them, and equality without white space."""
    s, content = parsed(spark, sf_dir), F.col("content")
    spaced = F.concat(F.lit(" "), F.replace(content, F.lit("\n"), F.lit("　")), F.lit("\n"))
    ids = F.array_join(F.transform(F.array_sort(F.transform(text.injected_ids(content), lambda x: F.replace(x, F.lit("GB/T"), F.lit("GB/T ")))), lambda x: F.replace(x, F.lit(" "), F.lit(""))), ",")
    return s.select("doc_id", "ord", text.replace_first(content, F.lit("应"), F.lit("宜")).alias("replaced"), text.with_note(content, F.lit("限值")).alias("noted"), text.with_supplement(content, F.lit("限值")).alias("supplemented"), ids.alias("ids"), text.same_description(content, spaced).alias("same"))


# Injectors

_LISTS = """lists AS (SELECT doc_id, count(*) AS n FROM c WHERE kind = 1 AND ord = (SELECT min(ord) FROM s WHERE s.doc_id = c.doc_id AND title = '规范性引用文件' AND content <> '') GROUP BY 1),
    entries AS (SELECT doc_id, count(*) AS n FROM c WHERE kind = 2 AND ord = (SELECT min(ord) FROM s WHERE s.doc_id = c.doc_id AND title = '术语和定义' AND content <> '') GROUP BY 1)"""
#: SQL of the documents in which an error of each type can be planted.
_FITS = {
    "E-S-03": "SELECT DISTINCT doc_id FROM s WHERE regexp_matches(title, '范围|规范性引用文件|术语和定义|参考文献|附录A')", "E-S-05": "SELECT DISTINCT doc_id FROM s WHERE title = '附录A（规范性）'", "E-S-06": "SELECT DISTINCT doc_id FROM s",
    **{t: f"SELECT DISTINCT doc_id FROM s WHERE regexp_matches(content, '{w}')" for t, w in (("E-T-01", "应"), ("E-T-02", "宜"), ("E-T-03", "应"), ("E-T-04", "应"), ("E-T-05", "应|宜|可"), ("E-T-06", "不应"), ("E-T-07", "应"))},
    "E-TM-05": "SELECT doc_id FROM entries WHERE n >= 3", "E-R-01": "SELECT doc_id FROM lists", "E-R-02": "SELECT doc_id FROM lists", "E-R-03": "SELECT doc_id FROM lists", "E-R-04": "SELECT doc_id FROM lists WHERE n >= 2",
}


@query(f"WITH {_S}, {_LISTS} " + " UNION ALL ".join(f"SELECT '{t}' AS error_type, doc_id FROM ({q})" for t, q in _FITS.items()))
def ce26_annotated_documents(spark, sf_dir):
    """CE3, CE5, CE6, CE10 to CE16, CE21 to CE26, JN18, UD4: the documents that each injector changes, over all documents."""
    s = stored(parsed(spark, sf_dir), "sections")
    return reduce(DataFrame.unionByName, [injectors.INJECTORS[t](s, 7).annotations.select(F.lit(t).alias("error_type"), "doc_id").distinct() for t in _FITS])


_WORDS = {"E-T-01": ("应", "宜"), "E-T-02": ("宜", "应"), "E-T-03": ("应", "可"), "E-T-04": ("应", "须"), "E-T-06": ("不应", "不宜"), "E-T-07": ("应", "宜")}


@query(f"WITH {_S} " + " UNION ALL ".join(f"SELECT '{t}' AS error_type, doc_id, 1::BIGINT AS changed, {1 if a[0] != '不' else 0}::BIGINT AS lost FROM (SELECT DISTINCT doc_id FROM s WHERE contains(content, '{a}'))" for t, (a, _) in _WORDS.items()))
def ce10_replaced_words(spark, sf_dir):
    """CE10 to CE13, CE15, CE16, FS14: of each document the sections that a wording error changes, and how often its first character fell away."""
    s = stored(parsed(spark, sf_dir), "sections")
    parts = []
    for t, (old, _) in _WORDS.items():
        new = injectors.INJECTORS[t](s, 7).sections.select("doc_id", "ord", F.col("content").alias("now"))
        both = s.join(new, ["doc_id", "ord"]).where("now <> content")
        lost = F.regexp_count("content", F.lit(old[0])) - F.regexp_count("now", F.lit(old[0]))
        parts.append(both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("changed"), F.sum(lost).alias("lost")).select(F.lit(t).alias("error_type"), "doc_id", "changed", "lost"))
    return reduce(DataFrame.unionByName, parts)


#: Types that the balanced choice draws from, in the order of their ties, and how often they were used before.
_POOL = allocation.tie_order(["E-S-05", "E-T-02", "E-T-06", "E-TM-05", "E-R-04"], 7)
_USED = {"E-T-02": 25, "E-S-05": 3}


@query(f"""WITH RECURSIVE {_S}, {_LISTS}, fits AS ({" UNION ALL ".join(f"SELECT '{t}' AS kind, doc_id FROM ({_FITS[t]})" for t in _POOL)}),
    own AS (SELECT doc_id, list(kind) AS kinds, string_agg(kind, ',' ORDER BY kind) AS key FROM fits GROUP BY 1), queue AS (SELECT row_number() OVER (ORDER BY key, doc_id) AS i, doc_id, [list_contains(kinds, x) for x in {_POOL!r}] AS ok FROM own),
    run AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, {[_USED.get(t, 0) for t in _POOL]!r}::BIGINT[] AS n, 0::BIGINT AS pick UNION ALL
        SELECT i, doc_id, [CASE WHEN k = pick THEN n[k] + 1 ELSE n[k] END for k in range(1, {len(_POOL) + 1})], pick FROM (SELECT q.i, q.doc_id, run.n,
            list_position([CASE WHEN q.ok[k] THEN run.n[k] END for k in range(1, {len(_POOL) + 1})], list_min([run.n[k] for k in range(1, {len(_POOL) + 1}) if q.ok[k]]))::BIGINT AS pick FROM run JOIN queue q ON q.i = run.i + 1))
    SELECT doc_id, {_POOL!r}[pick] AS error_type FROM run WHERE i > 0""")
def ce27_balanced_choices(spark, sf_dir):
    """CE27, TK7: the type that each document takes when the least used one goes next, as a counter in order would have it."""
    s = stored(parsed(spark, sf_dir), "sections")
    return allocation.balanced_choices(injectors.fitting_types(s, 7, _POOL), _USED, 7).select("doc_id", "error_type")


# Sources, sinks and table functions


@query(f"WITH {_S} SELECT doc_id::VARCHAR AS doc_id, length(string_agg('[' || section_number || '] ' || title || CASE WHEN content <> '' THEN chr(10) || content ELSE '' END, chr(10) ORDER BY ord)) AS n FROM s GROUP BY 1")
def io20_saved_texts(spark, sf_dir):
    """IO20: texts written and read back under their ids."""
    path = scratch(spark, "texts")
    benchmark.write_texts(standards(spark, sf_dir), path)
    return benchmark.read_texts(spark, path).select("doc_id", F.length("source_text").cast("bigint").alias("n"))


@query(f"WITH {_S} SELECT doc_id::VARCHAR AS doc_id, ord, section_number, title, content FROM s WHERE section_number LIKE '2%'")
def ud5_source_sections(spark, sf_dir):
    """UD5, IO8: sections through a Python data source over saved texts, with the leading number pushed to its readers."""
    review_source.register_sources(spark)
    path = scratch(spark, "texts")
    benchmark.write_texts(standards(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "source_text"), path)
    return spark.read.format("review_sections").load(path).where(F.col("section_number").startswith("2"))


@query(f"""WITH {_S}, {_ORDER} SELECT doc_id, 'E-S-02' AS error_type, ord, number::VARCHAR AS section_number, before || ' ' || old || ' > ' || number || ' ' || title AS reason FROM steps WHERE number <= before
    UNION ALL SELECT doc_id, 'E-S-03', ord, section_number, s.title || ' > ' || y.right_ FROM s JOIN (VALUES {_WRONG}) y(title, right_) USING (title) UNION ALL SELECT doc_id, 'E-S-06', ord, section_number, '6' FROM s WHERE section_number LIKE '9.%'""")
def ud3_structure_table(spark, sf_dir):
    """UD1, UD3, UD5: outline and structure review as table functions of SQL over all documents."""
    tables.register_tables(spark)
    standards(spark, sf_dir).createOrReplaceTempView("lectern_standards")
    return spark.sql("""
        WITH parsed AS (SELECT d.doc_id, o.* FROM lectern_standards d, LATERAL parse_outline(d.source_text) o)
        SELECT * FROM review_structure(TABLE(SELECT doc_id, ord, section_number, title FROM parsed), CAST(NULL AS INT))
    """)
