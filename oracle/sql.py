"""ANSI-style SQL per registered query; DuckDB runs it on the same Parquet tables."""

from __future__ import annotations

# The given tables.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# White space as Python sees it, as RE2 ranges.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda w: w <> '')"


def terms(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def clean(x: str) -> str:
    x = f"replace(replace({x}, '<s>', ''), '</s>', '')"
    x = rf"regexp_replace({x}, '/g\p{{Nd}}+', '', 'g')"
    x = rf"regexp_replace({x}, '\b\d+[{WS}]+of[{WS}]+\d+\b', '', 'g')"
    return strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def substituted(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def windows(source: str, keys: str, text: str, size: int) -> str:
    """CTE ``chunks``: word windows of a text column."""
    return f"""chunk_words AS (SELECT {keys}, {words(text)} AS w FROM {source}),
chunks AS (
  SELECT {keys}, CAST(s // {size} AS BIGINT) AS chunk_ord,
         array_to_string(w[s + 1 : s + {size}], ' ') AS chunk_text,
         CAST(least({size}, len(w) - s) AS BIGINT) AS n_tokens
  FROM (SELECT {keys}, w, unnest(range(0, len(w), {size})) AS s FROM chunk_words)
)"""


CORPUS_WORDS = [
    ("License", "cash transaction report; each branch shall prepare and submit to bfiu"),
    (" ndly ", " Suspicious Transaction report to the BFIU "),
    (" heed ", " know your customer "),
    (" shanin ", " anti money laundering "),
    (" thend ", " 3 of 40 /g12 "),
]
QUESTION_WORDS = [
    (" was ", " ctr rule "),
    (" are ", " suspicious transaction policy "),
    (" with ", " kyc compare "),
    (" for ", " aml how many "),
]

DOC_KEYS = "doc_id, source_file, file_type"
CORPUS = "corpus AS (SELECT doc_id, source AS source_file, lang AS file_type, text FROM documents)"
DOMAIN = (
    "domain AS (SELECT doc_id, source_file, file_type, "
    f"{substituted('text', CORPUS_WORDS)} AS text FROM corpus)"
)
TURNS = (
    f"turns AS (SELECT conv_id, turn, {substituted('text', QUESTION_WORDS)} AS text FROM conversations)"
)
QUESTIONS = """questions AS (
  SELECT conv_id, text AS question
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns)
  WHERE n = 1
)"""

LINES = """lines AS (
  SELECT n_name AS bank_name, s_name AS branch, strftime(o_orderdate, '%Y-%m') AS "month",
         lineitem.*, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)"""
STR = """str_kpi AS (
  SELECT bank_name, branch, "month", count(DISTINCT l_orderkey) AS str_filed_count,
         avg(CASE WHEN days >= 0 THEN days END) AS avg_str_filing_days,
         count(*) FILTER (WHERE days > 365) AS str_sla_breaches
  FROM lines GROUP BY ALL
)"""
CTR = """ctr_kpi AS (
  SELECT bank_name, branch, "month",
         count(*) FILTER (WHERE l_linestatus = 'F') AS ctrs_filed,
         count(*) FILTER (WHERE l_returnflag = 'R') AS ctrs_unreported,
         count(*) FILTER (WHERE l_extendedprice > 94700) AS txns_above_threshold
  FROM lines GROUP BY ALL
)"""
KYC = """kyc_kpi AS (
  SELECT n_name AS bank_name, c_mktsegment AS branch, strftime(o_orderdate, '%Y-%m') AS "month",
         count(*) FILTER (WHERE o_orderstatus = 'F') AS edd_completed,
         count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS edd_pending,
         count(DISTINCT CASE WHEN c_acctbal < 0 THEN c_custkey END) AS high_risk_customers
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL
)"""
SANCTIONS = """sanctions_kpi AS (
  SELECT 'bank_' || (user_id % 5) AS bank_name, 'branch_' || (user_id % 25) AS branch,
         strftime(ts, '%Y-%m') AS "month", count(*) AS transactions_screened,
         count(*) FILTER (WHERE event_type = 'error') AS sanctions_hits_flagged,
         count(*) FILTER (WHERE value > 113) AS sla_breaches
  FROM events GROUP BY ALL
)"""
TRAINING = """training_kpi AS (
  SELECT 'bank_' || (user_id % 5) AS bank_name, 'branch_' || (user_id % 25) AS branch,
         year(ts) || '-Q' || quarter(ts) AS "quarter", count(DISTINCT user_id) AS staff_total,
         count(DISTINCT CASE WHEN event_type = 'signup' AND value > 80 THEN user_id END) AS trained
  FROM events GROUP BY ALL
)"""
IN_QUARTER = "\"month\" IN ('1996-04', '1996-05', '1996-06')"


def rate(a: str, b: str, digits: int = 6) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {digits})"


PARAGRAPH = "chr(10) || chr(10)"
DOUBLED = """doubled AS (
  SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents
)"""


def level(k: int, separator: str, visible: bool, size: int, hard: bool) -> str:
    """CTEs from ``level_{k}`` to ``level_{k+1}``: one separator's greedy packing.

    Pointers lead from the first piece of a chunk to the first piece of the
    next: the one at which the running word count passes the bound. ``fresh``
    tells a piece kept as it is from one that was stripped when it did not
    fit. A hard cut leaves the last window of a piece as the first of a chunk.
    """
    spaced = f"CAST(p = '' OR regexp_matches(p, '[{WS}]$') AS INTEGER)" if visible else "0"
    kept = f"CASE WHEN n > {size} THEN (n - 1) % {size} + 1 ELSE n END" if hard else "n"
    full = f"CASE WHEN n > {size} THEN (n - 1) // {size} ELSE 0 END" if hard else "0"
    stripped = strip("p")
    opening = f"CASE WHEN fresh THEN p ELSE {stripped} END"
    if hard:
        rest = f"array_to_string({words('p')}[n - kept + 1 : n], ' ')"
        opening = f"CASE WHEN n > {size} THEN {rest} ELSE {opening} END"
    return f"""sized_{k} AS (
  SELECT row_number() OVER (ORDER BY doc_id, path) AS rid, doc_id, path, text,
         len({words('text')}) AS total FROM level_{k}
),
listed_{k} AS (
  SELECT rid, i, list[i + 1] AS p, len(list) AS many
  FROM (SELECT rid, list, unnest(range(0, len(list))) AS i
        FROM (SELECT rid, string_split(text, {separator}) AS list FROM sized_{k} WHERE total > {size}))
),
counted_{k} AS (SELECT *, len({words('p')}) AS n, {spaced} AS spaced FROM listed_{k}),
pieces_{k} AS (
  SELECT *, {kept} AS kept, {full} AS cuts, {stripped} = '' AS blank,
         sum(n + before) OVER (PARTITION BY rid ORDER BY i) AS cum
  FROM (SELECT *, coalesce(lag(spaced) OVER (PARTITION BY rid ORDER BY i), 0) AS before FROM counted_{k})
),
rises_{k} AS (SELECT rid, cum, min(i) AS i FROM pieces_{k} GROUP BY rid, cum),
ends_{k} AS (
  SELECT s.*, greatest(s.i + 1, coalesce(e.i, s.many)) AS e
  FROM (SELECT *, {size} - kept + cum + spaced - CASE WHEN fresh THEN spaced ELSE 0 END AS bound
        FROM pieces_{k}, (VALUES (true), (false)) f(fresh)) s
  ASOF LEFT JOIN rises_{k} e ON s.rid = e.rid AND e.cum > s.bound
),
moves_{k} AS (
  SELECT rid, i, fresh, many,
         CASE WHEN fresh THEN p = '' ELSE blank END AS nothing,
         CASE WHEN (fresh AND p = '') OR (NOT fresh AND blank) THEN i + 1 ELSE e END AS next_i,
         (fresh AND p = '') OR (NOT fresh AND blank) AS next_fresh
  FROM ends_{k}
),
starts_{k} AS (
  SELECT rid, CAST(0 AS BIGINT) AS i, true AS fresh FROM sized_{k} WHERE total > {size}
  UNION ALL
  SELECT s.rid, CAST(m.next_i AS BIGINT), m.next_fresh
  FROM starts_{k} s JOIN moves_{k} m ON m.rid = s.rid AND m.i = s.i AND m.fresh = s.fresh
  WHERE m.next_i < m.many
),
spans_{k} AS (
  SELECT s.rid, s.i, s.fresh, m.next_i AS e
  FROM starts_{k} s JOIN moves_{k} m ON m.rid = s.rid AND m.i = s.i AND m.fresh = s.fresh
  WHERE NOT m.nothing
),
bodies_{k} AS (
  SELECT rid, origin AS i, 1 AS kind, 0 AS cut_no, {strip(f"string_agg(CASE WHEN i = origin THEN {opening} ELSE p END, {separator} ORDER BY i)")} AS text
  FROM (SELECT b.i AS origin, b.fresh, p.* FROM spans_{k} b
        JOIN pieces_{k} p ON p.rid = b.rid AND p.i >= b.i AND p.i < b.e)
  GROUP BY rid, origin
),
cut_{k} AS (
  SELECT rid, i, 0 AS kind, cut_no, array_to_string({words('p')}[cut_no * {size} + 1 : (cut_no + 1) * {size}], ' ') AS text
  FROM (SELECT *, unnest(range(0, cuts)) AS cut_no FROM pieces_{k})
),
level_{k + 1} AS (
  SELECT doc_id, list_concat(path, [i, kind, cut_no]) AS path, o.text
  FROM (SELECT * FROM bodies_{k} UNION ALL SELECT * FROM cut_{k}) o JOIN sized_{k} USING (rid)
  UNION ALL
  SELECT doc_id, list_concat(path, [0, 1, 0]), {strip('text')} FROM sized_{k} WHERE total <= {size}
)"""


def packed(size: int, separators: list[tuple[str, bool]], hard: bool = False) -> str:
    """Greedy packing by each separator in turn, then word windows."""
    levels = [level(k, sep, visible, size, hard) for k, (sep, visible) in enumerate(separators)]
    return f"""WITH RECURSIVE {DOUBLED},
level_0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, text FROM doubled),
{", ".join(levels)},
final AS (
  SELECT doc_id, path, v, array_to_string(w[v + 1 : v + {size}], ' ') AS body, len(w) AS n, text
  FROM (SELECT doc_id, path, text, w, unnest(range(0, len(w), {size})) AS v
        FROM (SELECT *, {words('text')} AS w FROM level_{len(levels)}))
)
SELECT doc_id,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, v) - 1 AS BIGINT) AS chunk_ord,
       CASE WHEN n <= {size} THEN text ELSE body END AS chunk_text,
       CAST(len({words('body')}) AS BIGINT) AS n_tokens
FROM final
"""


def ranked(scores: str, group: str, order: str, k: int | None) -> str:
    """The first ``k`` rows of each group, or all of them, with their ranks."""
    every = f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rank FROM ({scores})"
    return f"SELECT * FROM ({every}) WHERE rank <= {k}" if k else every


def bm25(query: str, key: str, source: str, k: int | None = None) -> str:
    """CTEs up to ``lexical``: BM25 with k1 = 1.2 and b = 0.75."""
    return f"""doc_terms AS (SELECT doc_id, {terms('text')} AS w FROM {source}),
totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM doc_terms),
tf AS (SELECT doc_id, term, len, count(*) AS tf
       FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM doc_terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
query_terms AS (SELECT DISTINCT {key}, unnest({terms('text')}) AS term FROM {query}),
lexical AS ({ranked(f'''
  SELECT {key}, doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                   / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM query_terms JOIN df USING (term) JOIN tf USING (term), totals
  GROUP BY {key}, doc_id''', key, 'score DESC, doc_id', k)})"""


def dense(query: str, key: str, source: str, doc: str, k: int | None = None, name: str = "dense") -> str:
    return f"""{name} AS ({ranked(f'''
  SELECT q.{key}, c.{doc}, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM {query} q, {source} c WHERE q.embedding IS NOT NULL''', key, f'score DESC, {doc}', k)})"""


EMBEDDED = (
    "embedded AS (SELECT domain.*, embedding FROM domain JOIN embeddings ON vec_id = doc_id)"
)
ITEMS = (
    "items AS (SELECT item_id AS query_id, text, embedding "
    "FROM benchmark JOIN embeddings ON vec_id = item_id)"
)


def mentions(x: str, *listed: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{t}')" for t in listed) + ")"


# The words of the router.
ANALYTICAL = (
    "count",
    "total",
    "average",
    "rate",
    "most",
    "least",
    "highest",
    "lowest",
    "which branch",
    "how many",
    "compare",
)
DOCUMENT = (
    "regulation",
    "policy",
    "guideline",
    "requirement",
    "what does",
    "explain",
    "how to",
    "what are",
    "compliance",
    "rule",
    "law",
    "standard",
    "aml",
    "cft",
)
GATE = ("ctr", "str", "cash transaction", "suspicious transaction")
CTR_TERMS = ("ctr", "cash transaction")
STR_TERMS = ("str", "suspicious transaction")


def route(x: str) -> str:
    a, b = mentions(x, *ANALYTICAL), mentions(x, *DOCUMENT)
    return (
        f"CASE WHEN {a} AND {b} THEN 'both' WHEN {a} THEN 'sql' WHEN {b} THEN 'docs' "
        "ELSE 'default' END"
    )


def likes(x: str, required: str, *others: str) -> str:
    first = f"lower({x}) LIKE '{required}'"
    if not others:
        return f"({first})"
    return f"({first} AND (" + " OR ".join(f"lower({x}) LIKE '{o}'" for o in others) + "))"


def topic_pairs(question: str, text: str) -> str:
    """Does a text answer a topic of the question?"""
    kyc_or_more = f"{mentions(question, *GATE)} OR {mentions(question, 'kyc')}"
    return f"""(
  ({mentions(question, *CTR_TERMS)} AND {likes(text, '%cash transaction report%', '%branch%prepare%', '%submit%bfiu%', '%monthly%ctr%', '%report%ccu%')})
  OR ({mentions(question, *STR_TERMS)} AND {likes(text, '%suspicious transaction%', '%report%bfiu%', '%submit%sar%')})
  OR ({mentions(question, 'kyc')} AND {likes(text, '%know your customer%')})
  OR ({mentions(question, 'aml')} AND NOT ({kyc_or_more}) AND {likes(text, '%anti money laundering%')})
)"""


ROUTED = f"""routed AS (
  SELECT conv_id, question, {mentions('question', *ANALYTICAL)} AS needs_sql,
         {mentions('question', *DOCUMENT)} AS needs_docs, {mentions('question', *GATE)} AS gate,
         {route('question')} AS route
  FROM questions
)"""
ASKING = """asking AS (
  SELECT conv_id, embedding FROM routed JOIN embeddings ON vec_id = conv_id
  WHERE needs_docs OR NOT needs_sql
)"""
VECTOR_HITS = f"""{dense('asking', 'conv_id', 'embedded', 'doc_id', 5)},
vector_hits AS (SELECT dense.*, source_file, file_type, chunk_ord, chunk_text FROM dense JOIN chunks USING (doc_id))"""
KEYWORD_HITS = f"""keyword_hits AS ({ranked(f'''
  SELECT conv_id, doc_id, chunk_ord, source_file, file_type, chunk_text FROM routed, chunks
  WHERE needs_docs AND gate AND {topic_pairs('question', 'chunk_text')}''', 'conv_id', 'doc_id, chunk_ord', 3)})"""
EVIDENCE = [CORPUS, DOMAIN, windows("domain", DOC_KEYS, "text", 500), TURNS, QUESTIONS, EMBEDDED, ROUTED, ASKING]


def citation(body: str) -> str:
    return (
        "'[' || coalesce(file_type, 'Unknown') || ': ' || coalesce(source_file, 'Unknown') || ']' "
        f"|| chr(10) || {body}"
    )


NL2 = "chr(10) || chr(10)"
SEPARATOR = f"{NL2} || '---' || {NL2}"
DOC_BLOCKS = f"""doc_blocks AS (
  SELECT conv_id, string_agg({citation(clean('chunk_text'))}, {SEPARATOR} ORDER BY rank, chunk_ord) AS doc_context
  FROM vector_hits GROUP BY conv_id
)"""
KEYWORD_BLOCKS = f"""keyword_blocks AS (
  SELECT conv_id, string_agg({citation(f"left({clean('chunk_text')}, 500) || '...'")}, {SEPARATOR}
         ORDER BY rank) AS keyword_context
  FROM keyword_hits GROUP BY conv_id
)"""


def block(source: str, columns: dict[str, str], order: str, statement: str) -> str:
    """SELECT giving one ``block``: the first 50 of at most 100 rows as text."""
    line = " || ' | ' || ".join(
        f"coalesce(CAST({e} AS VARCHAR), 'NULL')" for e in columns.values()
    )
    header = " | ".join(columns)
    rule = "-+-".join("-" * max(3, len(c)) for c in columns)
    return f"""SELECT CASE WHEN count(*) = 0
    THEN 'SQL Query Executed:' || chr(10) || '{statement}' || {NL2} || 'No results found for this query.'
    ELSE 'SQL Query Executed:' || chr(10) || '{statement}' || {NL2} || 'Results:' || chr(10)
      || '{header}' || chr(10) || '{rule}' || chr(10)
      || string_agg(line, chr(10) ORDER BY n) FILTER (WHERE n <= 50)
      || CASE WHEN count(*) > 50
         THEN chr(10) || '(Showing first 50 of ' || count(*) || ' rows)' ELSE '' END
      || {NL2} || 'Total rows: ' || count(*) END AS block
  FROM (SELECT row_number() OVER (ORDER BY {order}) AS n, {line} AS line FROM ({source})) WHERE n <= 100"""


UNREPORTED = f"""SELECT bank_name, branch, CAST(sum(ctrs_unreported) AS BIGINT) AS total_unreported_ctrs,
       CAST(sum(ctrs_filed) AS BIGINT) AS total_filed_ctrs
FROM ctr_kpi WHERE {IN_QUARTER} GROUP BY bank_name, branch
ORDER BY total_unreported_ctrs DESC, bank_name, branch LIMIT 10"""


def breaches(n: int) -> str:
    return f"""SELECT bank_name, branch, CAST(sum(str_sla_breaches) AS BIGINT) AS total_breaches
FROM str_kpi GROUP BY bank_name, branch
ORDER BY total_breaches DESC, bank_name, branch LIMIT {n}"""


EDD = f"""SELECT bank_name, CAST(sum(edd_completed) AS BIGINT) AS edd_completed,
       CAST(sum(edd_pending) AS BIGINT) AS edd_pending,
       {rate('sum(edd_completed)', 'sum(edd_completed) + sum(edd_pending)')} AS completion_rate
FROM kyc_kpi GROUP BY bank_name"""
FILING = f"""SELECT bank_name, branch, CAST(sum(ctrs_filed) AS BIGINT) AS ctrs_filed,
       CAST(sum(ctrs_unreported) AS BIGINT) AS ctrs_unreported,
       {rate('sum(ctrs_filed)', 'sum(ctrs_filed) + sum(ctrs_unreported)')} AS filing_rate
FROM ctr_kpi GROUP BY bank_name, branch"""

METRIC_WORDS = [
    (" was ", " ctr filed in NATION_15, 1996-Q2? "),
    (" are ", " suspicious transaction reports of Supplier#000000003 "),
    (" with ", " kyc at NATION_3 in 1995-07. "),
    (" for ", " sanctions screening of bank_2 "),
    (" from ", " staff training below 95% at branch_7 "),
    (" by ", " count of everything in 1997-02 "),
]
# Per KPI table the words that ask for it, its measures, and its figure.
METRICS = {
    "ctr_reporting_kpi": (("ctr", "cash transaction"), ("ctrs_unreported", "ctrs_filed", "txns_above_threshold"), "filing_rate"),
    "kyc_edd_kpi": (("kyc", "edd", "due diligence"), ("edd_pending", "edd_completed", "high_risk_customers"), "completion_rate"),
    "sanctions_screening_kpi": (("sanction", "screening"), ("sla_breaches", "sanctions_hits_flagged", "transactions_screened"), "breach_rate"),
    "training_compliance_kpi": (("training", "trained"), ("staff_untrained", "staff_trained_aml_cft", "staff_total"), "training_rate"),
    "str_filing_kpi": (("str", "suspicious transaction"), ("str_sla_breaches", "str_filed_count"), "avg_str_filing_days"),
}


def metric_ctes(source: str, key: str) -> list[str]:
    """CTEs up to ``answers`` (key, table, bank, branch, period, block) for (key, question)."""
    edge = "[^\\p{L}\\p{N}]"
    which = " ".join(
        f"WHEN regexp_matches(lower(question), '(^|{edge})({'|'.join(words)})s?($|{edge})') THEN '{t}'" for t, (words, _, _) in METRICS.items()
    )
    month_quarter = "left(\"month\", 4) || '-Q' || ((CAST(\"month\"[6:7] AS INTEGER) + 2) // 3)"

    def part(name: str, cte: str, a: str, b: str, c: str, num: str, den: str) -> str:
        return (f"SELECT '{name}' AS tab, bank_name, branch, \"month\" AS m, {month_quarter} AS q, {a} AS a, {b} AS b, {c} AS c, "
                f"CAST({num} AS DOUBLE) AS num, CAST({den} AS DOUBLE) AS den FROM {cte}")

    heads = " ".join(
        f"WHEN '{t}' THEN '" + " | ".join(cols) + "' || chr(10) || '" + "-+-".join("-" * len(x) for x in cols) + "'"
        for t, (_, own, figure) in METRICS.items()
        for cols in [("bank_name", "branch", *own, figure)]
    )
    several = lambda kind: (
        f"(SELECT list(name ORDER BY pos) FROM (SELECT name, min(pos) AS pos FROM found f WHERE f.{key} = s.{key} AND f.kind = '{kind}' GROUP BY name))"
    )
    return [
        "facts AS (" + " UNION ALL ".join([
            part("ctr_reporting_kpi", "ctr_kpi", "ctrs_unreported", "ctrs_filed", "txns_above_threshold", "ctrs_filed", "ctrs_filed + ctrs_unreported"),
            part("kyc_edd_kpi", "kyc_kpi", "edd_pending", "edd_completed", "high_risk_customers", "edd_completed", "edd_completed + edd_pending"),
            part("sanctions_screening_kpi", "sanctions_kpi", "sla_breaches", "sanctions_hits_flagged", "transactions_screened", "sla_breaches", "transactions_screened"),
            part("str_filing_kpi", "str_kpi", "str_sla_breaches", "str_filed_count", "NULL::BIGINT", "avg_str_filing_days * str_filed_count",
                 "CASE WHEN avg_str_filing_days IS NOT NULL THEN str_filed_count END"),
            "SELECT 'training_compliance_kpi', bank_name, branch, NULL, \"quarter\", staff_total - trained, trained, staff_total, trained, staff_total FROM training_kpi",
        ]) + ")",
        "names AS (SELECT DISTINCT 'bank' AS kind, bank_name AS name FROM facts UNION SELECT DISTINCT 'branch', branch FROM facts)",
        f"""found AS (
  SELECT {key}, kind, name, pos
  FROM (SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS pos
        FROM (SELECT {key}, list_filter(string_split_regex(lower(question), '[\\s?.,!;:]+'), lambda x: x <> '') AS w FROM {source}))
  JOIN names ON lower(name) = word
)""",
        f"""asked AS (
  SELECT {key}, CASE {which} END AS tab, {several('bank')} AS banks, {several('branch')} AS branches,
         list_transform(regexp_extract_all(question, '(?i)\\b([0-9]{{4}}-(?:q[1-4]|[0-9]{{2}}))\\b', 1), lambda p: upper(p)) AS named
  FROM {source} s
)""",
        # Periods once each, in the order they are first named.
        """told AS (
  SELECT * EXCLUDE (named), list_filter(named, lambda p, i: list_position(named, p) = i) AS periods FROM asked
)""",
        f"""each_key AS (
  SELECT {key}, tab, ib, ir, ip, bank, branch, period,
         tab || ', bank ' || bank || ', branch ' || branch || ', period ' || period AS statement
  FROM (SELECT {key}, tab, bank, ib, branch, ir, unnest(p) AS period, generate_subscripts(p, 1) AS ip
        FROM (SELECT *, unnest(r) AS branch, generate_subscripts(r, 1) AS ir
              FROM (SELECT *, unnest(b) AS bank, generate_subscripts(b, 1) AS ib
                    FROM (SELECT {key}, tab, CASE WHEN len(banks) > 0 THEN banks ELSE ['*'] END AS b,
                                 CASE WHEN len(branches) > 0 THEN branches ELSE ['*'] END AS r,
                                 CASE WHEN len(periods) > 0 THEN periods ELSE ['*'] END AS p
                          FROM told WHERE tab IS NOT NULL))))
)""",
        """summed AS (
  SELECT statement, s.tab, f.bank_name, f.branch, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(num) / nullif(sum(den), 0) AS figure
  FROM (SELECT DISTINCT tab, bank, branch, period, statement FROM each_key) s
  JOIN facts f ON f.tab = s.tab AND s.bank IN ('*', f.bank_name) AND s.branch IN ('*', f.branch)
    AND (s.period = '*' OR s.period = f.m OR s.period = f.q)
  GROUP BY ALL HAVING s.tab <> 'training_compliance_kpi' OR sum(b) < 0.95 * sum(c)
)""",
        f"""blocks AS (
  SELECT statement, {NL2} || 'Results:' || chr(10) || CASE any_value(tab) {heads} END || chr(10)
    || string_agg(concat_ws(' | ', bank_name, branch, CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR),
         coalesce(CAST(CAST(round(figure, 4) AS DECIMAL(18,4)) AS VARCHAR), 'NULL')), chr(10) ORDER BY n) FILTER (WHERE n <= 50)
    || CASE WHEN count(*) > 50 THEN chr(10) || '(Showing first 50 of ' || count(*) || ' rows)' ELSE '' END
    || {NL2} || 'Total rows: ' || count(*) AS found
  FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY a DESC, bank_name, branch) AS n FROM summed)
  WHERE n <= 100 GROUP BY statement
)""",
        f"""bodies AS (
  SELECT {key}, string_agg('SQL Query Executed:' || chr(10) || statement || coalesce(found, {NL2} || 'No results found for this query.'),
         {NL2} ORDER BY ib, ir, ip) AS body
  FROM each_key LEFT JOIN blocks USING (statement) GROUP BY {key}
)""",
        f"""answers AS (
  SELECT {key}, tab AS kpi_table, nullif(array_to_string(banks, ', '), '') AS bank, nullif(array_to_string(branches, ', '), '') AS branch,
         nullif(array_to_string(periods, ', '), '') AS period,
         CASE WHEN tab IS NULL THEN 'No results found for this query.' ELSE body END AS block
  FROM told LEFT JOIN bodies USING ({key})
)""",
    ]


ROW_TEXT = """row_texts AS (
  SELECT bank_name, branch, "month", concat_ws(chr(10), 'Source: str_filing_kpi.csv',
    'bank_name: ' || bank_name, 'branch: ' || branch, 'month: ' || "month",
    'str_filed_count: ' || str_filed_count,
    'avg_str_filing_days: ' || CAST(CAST(avg_str_filing_days AS DECIMAL(18,2)) AS VARCHAR),
    'str_sla_breaches: ' || str_sla_breaches) AS row_text
  FROM str_kpi
)"""

GAPS = """SELECT *, str_filing_kpi_gaps + ctr_reporting_kpi_gaps + kyc_edd_kpi_gaps
          + sanctions_screening_kpi_gaps AS total_gaps
FROM (
  SELECT bank_name, branch, "month",
         CAST(coalesce(any_value(str_sla_breaches), 0) AS BIGINT) AS str_filing_kpi_gaps,
         CAST(coalesce(any_value(ctrs_unreported), 0) AS BIGINT) AS ctr_reporting_kpi_gaps,
         CAST(coalesce(any_value(edd_pending), 0) AS BIGINT) AS kyc_edd_kpi_gaps,
         CAST(coalesce(any_value(sla_breaches), 0) AS BIGINT) AS sanctions_screening_kpi_gaps
  FROM str_kpi FULL JOIN ctr_kpi USING (bank_name, branch, "month")
  FULL JOIN kyc_kpi USING (bank_name, branch, "month")
  FULL JOIN sanctions_kpi USING (bank_name, branch, "month")
  GROUP BY bank_name, branch, "month"
)
WHERE total_gaps > 0"""

JOINED_PAGES = """pages_joined AS (
  SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id
)"""
BLANKED = """blanked AS (
  SELECT doc_id, lang AS file_type, CASE WHEN toxic = 1 THEN '' ELSE text END AS text
  FROM documents LEFT JOIN labels USING (doc_id)
)"""
VERSIONS = """latest AS (
  SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS version,
         CASE WHEN l.doc_id IS NULL THEN text ELSE 'Revised. ' || text END AS text
  FROM documents LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) <> 1
)"""
STATE = """state AS (
  SELECT corpus.* REPLACE (CASE WHEN source_file LIKE '%3' THEN 'Revised. ' || text ELSE text END AS text)
  FROM corpus LEFT JOIN labels USING (doc_id) WHERE source_file NOT LIKE '%3' OR coalesce(toxic, 0) <> 1
)"""


def named_windows(name: str, source: str) -> str:
    """CTE of that name: windows of 100 words."""
    return windows(source, DOC_KEYS, "text", 100).replace("chunk_words", f"{name}_words").replace("chunks AS", f"{name} AS")


CHUNK_COLUMNS = "source_file, file_type, chunk_ord, chunk_text, n_tokens"

ORACLES: dict[str, str] = {
    "s1_discover_files": f"SELECT * FROM (VALUES {', '.join(f"('{t}.parquet', 'PARQUET')" for t in TABLES)}) f(file_name, file_type)",
    "s2_scan_documents": """SELECT conv_id, turn,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS BIGINT) AS char_start, text
FROM conversations WHERE text <> ''""",
    "s2_chunk_pages": with_(JOINED_PAGES, windows("pages_joined", "conv_id", "text", 50))
    + "SELECT conv_id, chunk_ord, chunk_text FROM chunks",
    "s3_load_csv": with_(LINES, CTR) + "SELECT * FROM ctr_kpi",
    "s4_table_name": """SELECT file_name,
  replace(replace(replace(file_name, '.csv', ''), '-', '_'), ' ', '_') AS table_name
FROM (SELECT source || ' ' || lang || '-' || doc_id || '.csv' AS file_name FROM documents)""",
    "s5_write_chunks": with_(CORPUS, windows("corpus", DOC_KEYS, "text", 500))
    + f"SELECT {CHUNK_COLUMNS}, 1 AS id_count FROM chunks",
    "s6_reset_table": with_(CORPUS, windows("corpus", DOC_KEYS, "text", 100))
    + f"SELECT {CHUNK_COLUMNS} FROM chunks",
    "s6_partial_refresh": with_(CORPUS, STATE, windows("state", DOC_KEYS, "text", 100))
    + f"SELECT {CHUNK_COLUMNS} FROM chunks",
    "s7_scan_chunks": with_(CORPUS, DOMAIN, windows("domain", DOC_KEYS, "text", 500))
    + "SELECT source_file, chunk_ord, n_tokens FROM chunks",
    "s8_ingest_summary": with_(BLANKED, windows("blanked", "doc_id, file_type", "text", 500))
    + """SELECT file_type, count(*) AS files_total, count(n) AS files_processed,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks_stored
FROM blanked LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) USING (doc_id)
GROUP BY file_type""",
    "s8_ingest_ledger": with_(
        CORPUS, LINES, STR, CTR, KYC, SANCTIONS, TRAINING,
        "blanked AS (SELECT * REPLACE (CASE WHEN source_file LIKE '%3' THEN '' ELSE text END AS text) FROM corpus)",
        windows("blanked", DOC_KEYS, "text", 500),
        """csvs AS (
  SELECT 'str_filing_kpi' AS t, count(*) AS n FROM str_kpi UNION ALL SELECT 'ctr_reporting_kpi', count(*) FROM ctr_kpi
  UNION ALL SELECT 'kyc_edd_kpi', count(*) FROM kyc_kpi UNION ALL SELECT 'sanctions_screening_kpi', count(*) FROM sanctions_kpi
  UNION ALL SELECT 'training_compliance_kpi', count(*) FROM training_kpi
)""",
    )
    + """SELECT 'first' AS run, source_file AS file_name, file_type, CASE WHEN n > 0 THEN 'loaded' ELSE 'empty' END AS status,
       CASE WHEN n > 0 THEN 'chunks' END AS table_name, CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bad_values,
       coalesce(n, 0) AS chunks
FROM (SELECT DISTINCT source_file, file_type FROM corpus)
LEFT JOIN (SELECT source_file, file_type, count(*) AS n FROM chunks GROUP BY ALL) USING (source_file, file_type)
UNION ALL SELECT 'first', CASE t WHEN 'kyc_edd_kpi' THEN 'kyc-edd kpi.csv' ELSE t || '.csv' END, 'CSV', 'loaded', t, n, 0, 0 FROM csvs
UNION ALL SELECT 'first', 'kyc_edd_kpi.csv', 'CSV', 'failed', NULL, 0, 0, 0""",
    "c1_chunk_fixed": with_(CORPUS, windows("corpus", DOC_KEYS, "text", 500))
    + f"SELECT {DOC_KEYS}, chunk_ord, chunk_text, n_tokens FROM chunks",
    "c2_chunk_greedy": packed(60, [(PARAGRAPH, False)], hard=True),
    "c2_chunk_progressive": packed(60, [(PARAGRAPH, False)]),
    "c2_chunk_all_separators": packed(
        60,
        [(PARAGRAPH, False), ("chr(10)", False), ("'. '", True), ("', '", True), ("' '", False)],
    ),
    "c3_rows_to_text": with_(LINES, STR, ROW_TEXT) + "SELECT * FROM row_texts",
    "c3_row_chunks": with_(
        LINES, STR, ROW_TEXT, windows("row_texts", 'bank_name, branch, "month"', "row_text", 8)
    )
    + "SELECT * FROM chunks",
    "c4_clean_text": "SELECT doc_id, "
    + clean("'<s>' || replace(text, ' of ', ' 3 of 40 /g12 ') || ' </s>  '")
    + " AS clean_text FROM documents",
    "c5_token_count": f"SELECT doc_id, CAST(len({words('text')}) AS BIGINT) AS n_tokens FROM documents",
    "c6_chunk_preview": with_(CORPUS, windows("corpus", DOC_KEYS, "text", 500))
    + """SELECT doc_id, chunk_ord, file_type, source_file, left(chunk_text, 100) AS chunk_preview,
       length(chunk_text) AS chunk_length
FROM chunks ORDER BY doc_id DESC, chunk_ord DESC LIMIT 20""",
    "c7_corpus_stats": with_(CORPUS, windows("corpus", DOC_KEYS, "text", 500))
    + """SELECT file_type, count(*) AS total_chunks, count(DISTINCT source_file) AS file_count,
       round(avg(length(chunk_text)), 6) AS avg_chunk_length,
       min(length(chunk_text)) AS min_chunk_length, max(length(chunk_text)) AS max_chunk_length
FROM chunks GROUP BY file_type ORDER BY file_type""",
    "f1_equality_conjunction": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F'""",
    "f2_in_quarter": with_(LINES, CTR) + f"SELECT * FROM ctr_kpi WHERE {IN_QUARTER}",
    "f3_case_folded_like": "SELECT doc_id, source AS source_file FROM documents "
    "WHERE lower(text) LIKE '%the%license%'",
    "f4_topic_predicates": with_(CORPUS, DOMAIN)
    + "SELECT doc_id, source_file FROM domain WHERE "
    + " OR ".join(
        [
            likes("text", "%cash transaction%", "%branch%prepare%", "%monthly%ctr%"),
            likes("text", "%suspicious transaction%", "%report%bfiu%", "%submit%sar%"),
            likes("text", "%know your customer%"),
        ]
    ),
    "f5_ratio_threshold": with_(KYC, f"edd AS ({EDD})")
    + "SELECT bank_name, completion_rate FROM edd WHERE completion_rate < 0.34",
    "f6_projection": """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line,
       round(l_extendedprice * (1 - l_discount), 4) AS net_price FROM lineitem""",
    "f7_excerpt": f"SELECT doc_id, left({clean('text')}, 500) || '...' AS excerpt FROM documents",
    "f8_null_rendering": with_(LINES, STR)
    + """SELECT bank_name, branch, "month",
  coalesce(CAST(CAST(avg_str_filing_days AS DECIMAL(18,2)) AS VARCHAR), 'NULL') AS avg_days FROM str_kpi""",
    "k1_branch_breaches": with_(LINES, STR)
    + """SELECT bank_name, branch, "month", str_filed_count,
       round(avg_str_filing_days, 6) AS avg_str_filing_days, str_sla_breaches
FROM str_kpi
WHERE bank_name = 'NATION_15' AND branch = 'Supplier#000000000' AND "month" = '1996-05'""",
    "k2_most_unreported_ctrs": with_(LINES, CTR) + UNREPORTED,
    "k3_edd_completion_rate": with_(KYC) + EDD,
    "k4_most_str_breaches": with_(LINES, STR) + breaches(1),
    "k5_branch_quarter_ctrs": with_(LINES, CTR)
    + f"SELECT * FROM ctr_kpi WHERE branch = 'Supplier#000000000' AND {IN_QUARTER}",
    "k6_training_below": with_(TRAINING)
    + f"""SELECT * FROM (
  SELECT bank_name, branch, CAST(sum(staff_total) AS BIGINT) AS staff_total,
         CAST(sum(trained) AS BIGINT) AS staff_trained,
         {rate('sum(trained)', 'sum(staff_total)')} AS training_rate
  FROM training_kpi GROUP BY bank_name, branch) WHERE training_rate < 0.95""",
    "k7_ctr_filing_rate": with_(LINES, CTR) + FILING,
    "k8_sanctions_rates": with_(SANCTIONS)
    + f"""SELECT bank_name, branch, CAST(sum(transactions_screened) AS BIGINT) AS transactions_screened,
       {rate('sum(sanctions_hits_flagged)', 'sum(transactions_screened)')} AS hit_rate,
       {rate('sum(sla_breaches)', 'sum(transactions_screened)')} AS breach_rate
FROM sanctions_kpi GROUP BY bank_name, branch""",
    "k9_str_timeliness": with_(LINES, STR)
    + """SELECT bank_name, CAST(sum(str_filed_count) AS BIGINT) AS filings,
       round(sum(avg_str_filing_days * str_filed_count) / sum(str_filed_count), 4) AS avg_days
FROM str_kpi WHERE avg_str_filing_days IS NOT NULL GROUP BY bank_name""",
    "k10_high_risk_customers": with_(KYC)
    + """SELECT bank_name, "month", CAST(sum(high_risk_customers) AS BIGINT) AS high_risk_customers
FROM kyc_kpi GROUP BY bank_name, "month\"""",
    "k10_customers_by_period": """SELECT n_name AS bank_name, period, count(DISTINCT c_custkey) AS customers
FROM (SELECT n_name, c_custkey, unnest([strftime(o_orderdate, '%Y-%m'),
             strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate), 'all']) AS period
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0)
GROUP BY ALL""",
    "k11_quarterly_volumes": with_(LINES, STR)
    + """SELECT bank_name,
       left("month", 4) || '-Q' || ((CAST("month"[6:7] AS INTEGER) + 2) // 3) AS "quarter",
       CAST(sum(str_filed_count) AS BIGINT) AS str_filed_count,
       CAST(sum(str_sla_breaches) AS BIGINT) AS str_sla_breaches
FROM str_kpi GROUP BY 1, 2""",
    "k12_gap_flags": with_(LINES, CTR)
    + """SELECT bank_name, branch, "month", ctrs_unreported,
       CASE WHEN ctrs_unreported > 0 THEN 'GAP' ELSE 'OK' END AS gap FROM ctr_kpi""",
    "k13_compliance_gaps": with_(LINES, STR, CTR, KYC, SANCTIONS) + GAPS,
    "v1_vector_topk": with_(ITEMS, dense("items", "query_id", "embeddings", "vec_id", 5))
    + "SELECT dense.*, CAST(label AS BIGINT) AS label FROM dense JOIN embeddings USING (vec_id)",
    "v2_keyword_search": with_(CORPUS, DOMAIN, windows("domain", DOC_KEYS, "text", 100))
    + f"""SELECT doc_id, chunk_ord, source_file, file_type, chunk_text FROM chunks
WHERE {topic_pairs("'Which CTR, suspicious transaction and KYC rules bind a branch?'", 'chunk_text')}
ORDER BY doc_id, chunk_ord LIMIT 3""",
    "v3_keyword_batch": with_(
        CORPUS, DOMAIN, TURNS, QUESTIONS, windows("domain", DOC_KEYS, "text", 100)
    )
    + "SELECT conv_id, rank, doc_id, chunk_ord, chunk_text FROM ("
    + ranked(
        f"SELECT * FROM questions, chunks WHERE {topic_pairs('question', 'chunk_text')}",
        "conv_id",
        "doc_id, chunk_ord",
        3,
    )
    + ")",
    "v4_bm25_topk": with_(bm25("benchmark", "item_id", "documents", 5)) + "SELECT * FROM lexical",
    "v4_bm25_index": with_(bm25("benchmark", "item_id", "documents", 5)) + "SELECT * FROM lexical",
    "v5_hybrid_topk": with_(
        CORPUS,
        DOMAIN,
        EMBEDDED,
        ITEMS,
        bm25("items", "query_id", "domain"),
        dense("items", "query_id", "embedded", "doc_id"),
    )
    + ranked(
        """SELECT query_id, doc_id,
  round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 6) AS score,
  CAST((d.rank IS NOT NULL)::INTEGER + (l.rank IS NOT NULL)::INTEGER AS BIGINT) AS lists
FROM dense d FULL JOIN lexical l USING (query_id, doc_id)""",
        "query_id",
        "score DESC, doc_id",
        5,
    ),
    "v6_concat_retrieval": with_(*EVIDENCE, VECTOR_HITS, KEYWORD_HITS)
    + """SELECT conv_id, doc_id, chunk_ord, source_file, rank, 'vector' AS section FROM vector_hits
UNION ALL SELECT conv_id, doc_id, chunk_ord, source_file, rank, 'keyword' FROM keyword_hits""",
    "v7_order_limit": """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
    "v8_row_cap": with_(LINES, CTR)
    + """SELECT *, least(100, (SELECT count(*) FROM ctr_kpi)) AS total_rows
FROM (SELECT *, row_number() OVER (ORDER BY ctrs_unreported DESC, bank_name, branch, "month") AS row_no
      FROM ctr_kpi) WHERE row_no <= 50""",
    "q1_last_question": with_(TURNS, QUESTIONS) + "SELECT * FROM questions",
    "q2_needs_sql": with_(TURNS)
    + f"SELECT conv_id, turn, {mentions('text', *ANALYTICAL)} AS needs_sql FROM turns",
    "q3_needs_docs": with_(TURNS)
    + f"SELECT conv_id, turn, {mentions('text', *DOCUMENT)} AS needs_docs FROM turns",
    "q4_keyword_gate": with_(TURNS)
    + f"SELECT conv_id, turn, {mentions('text', *GATE)} AS keyword_gate FROM turns",
    "q5_route": with_(TURNS) + f"SELECT {route('text')} AS route, count(*) AS turns FROM turns GROUP BY 1",
    "q6_citation_block": with_(*EVIDENCE, VECTOR_HITS, DOC_BLOCKS) + "SELECT * FROM doc_blocks",
    "q7_result_block": with_(LINES, CTR)
    + block(
        FILING,
        {
            "bank_name": "bank_name",
            "branch": "branch",
            "ctrs_filed": "ctrs_filed",
            "ctrs_unreported": "ctrs_unreported",
            "filing_rate": "CAST(filing_rate AS DECIMAL(18,2))",
        },
        "bank_name, branch",
        "CTR filing by branch",
    ),
    "q8_assemble_context": with_(
        *EVIDENCE,
        VECTOR_HITS,
        KEYWORD_HITS,
        DOC_BLOCKS,
        KEYWORD_BLOCKS,
        LINES,
        STR,
        CTR,
        KYC,
        SANCTIONS,
        TRAINING,
        "metric_questions AS (SELECT conv_id, question FROM routed WHERE needs_sql)",
        *metric_ctes("metric_questions", "conv_id"),
    )
    + f"""SELECT conv_id, route, {NL2} || repeat('=', 70) || concat_ws({NL2},
  CASE WHEN needs_sql THEN '[SQL Query Results]' || chr(10) || block END,
  CASE WHEN needs_docs AND (doc_context IS NOT NULL OR keyword_context IS NOT NULL)
    THEN '[Document Context]' || chr(10) || concat_ws(chr(10), doc_context,
         chr(10) || '[Additional Keyword Matches]' || chr(10) || keyword_context)
    WHEN NOT needs_docs AND NOT needs_sql AND doc_context IS NOT NULL
    THEN '[Document Context]' || chr(10) || doc_context END) AS context
FROM routed LEFT JOIN doc_blocks USING (conv_id) LEFT JOIN keyword_blocks USING (conv_id)
LEFT JOIN answers USING (conv_id)""",
    "q8_metric_answers": with_(
        f"""metric_turns AS (
  SELECT conv_id || '-' || turn AS turn_id, {substituted('text', METRIC_WORDS)} AS question FROM conversations
)""",
        LINES, STR, CTR, KYC, SANCTIONS, TRAINING, *metric_ctes("metric_turns", "turn_id"),
    )
    + "SELECT * FROM answers",
    "q9_cited_sources": with_(*EVIDENCE, VECTOR_HITS)
    + """SELECT conv_id, route,
  coalesce(files, 'I don''t have that information in my Knowledge Base.') AS sources
FROM routed LEFT JOIN (
  SELECT conv_id, string_agg(DISTINCT source_file, ', ' ORDER BY source_file) AS files
  FROM vector_hits GROUP BY conv_id) USING (conv_id)""",
    "text_strip_sql_fence": f"SELECT conv_id, turn, {strip('text')} AS statement FROM conversations",
    "t1_sync_chunks": with_(windows("documents", "doc_id, source, lang", "text", 500))
    + f"""SELECT * FROM (SELECT doc_id, source, lang, chunk_ord, {clean('chunk_text')} AS chunk_text FROM chunks)
WHERE chunk_text <> ''""",
    "t1_change_feed": with_(CORPUS, STATE, named_windows("was", "corpus"), named_windows("is_now", "state"))
    + """SELECT n.source_file, n.file_type, n.chunk_ord, n.chunk_text, n.n_tokens,
       CASE WHEN w.chunk_text = n.chunk_text AND w.n_tokens = n.n_tokens THEN 1 ELSE 2 END::BIGINT AS version
FROM is_now n LEFT JOIN was w USING (doc_id, chunk_ord) WHERE n.source_file NOT LIKE '%7'""",
    "t2_upsert_chunks": with_(VERSIONS, windows("latest", "doc_id, version", "text", 500))
    + "SELECT doc_id, version, chunk_ord, chunk_text FROM chunks",
    "t3_changed_documents": f"""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'new'
  WHEN toxic = 1 THEN 'removed' WHEN {clean('text')} <> text THEN 'changed' ELSE 'unchanged' END AS status
FROM documents LEFT JOIN labels l USING (doc_id)""",
    "t3_changed_chunks": with_(CORPUS, STATE, named_windows("was", "corpus"), named_windows("is_now", "state"))
    + """SELECT doc_id, chunk_ord, CASE WHEN w.source_file IS NULL THEN 'new' WHEN n.source_file IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM was w FULL JOIN is_now n USING (doc_id, chunk_ord) WHERE w.chunk_text IS DISTINCT FROM n.chunk_text""",
}
# Rules as a table give what the rules as code give.
ORACLES["v3_rule_table"] = ORACLES["v3_keyword_batch"]
