"""The registered queries in plain SQL, written from the definitions rather than from the Spark jobs.

Retrieval here is the long form (one row per token, term and candidate) that the jobs avoid.
"""

from __future__ import annotations

from evalspark.functions import stems
from evalspark.functions.metrics import HEADLINE, KS, METRICS
from evalspark.functions.text import STOPWORDS
from evalspark.operators import bootstrap
from evalspark.operators.bm25 import bm25_grid

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKEN = r"'[a-z]+|\d+(?:,\d{3}\b)*(?:\.\d+(?:,\d{3}\b)*)?'"


def toks(text: str) -> str:
    return f"list_transform(regexp_extract_all(lower({text}), {TOKEN}), lambda t: replace(t, ',', ''))"


def fixed(x: str, digits: int = 2) -> str:
    return f"CAST(CAST({x} AS DECIMAL(28,{digits})) AS VARCHAR)"


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ---------- order records ----------

LINES = f"""lines AS (
  SELECT 'C' || o_custkey || '/' || year(o_orderdate) || '/order_' || l_orderkey || '.pdf' AS doc_id,
         'C' || o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, 'order_' || l_orderkey || '.pdf' AS page,
         l.*, o.*, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'dev' ELSE 'test' END AS split,
         CASE l_linenumber WHEN 1 THEN l_extendedprice - l_extendedprice * l_discount WHEN 2 THEN l_extendedprice / l_quantity
              WHEN 4 THEN o_totalprice / 100 WHEN 5 THEN o_totalprice + l_quantity * l_quantity
              WHEN 6 THEN l_quantity + l_discount / 100 END AS v,
         {fixed('l_tax')} AS tax
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"""

AUDIT = f"""audit AS (
  SELECT *, doc_id || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS question_id,
    CASE WHEN l_linenumber = 3 THEN CASE WHEN l_quantity > 25 THEN 'yes' ELSE 'no' END
         WHEN l_linenumber < 7 THEN CAST(v AS VARCHAR) END AS value_text,
    CASE WHEN l_linenumber < 7 THEN NULL WHEN l_returnflag = 'R' THEN 'division_by_zero'
         WHEN l_returnflag = 'A' THEN 'forward_reference' ELSE 'row_not_found' END AS program_err,
    CASE WHEN l_linenumber <> 3 THEN CAST({fixed('coalesce(v, 1.0)', 8)} AS DOUBLE) END AS g,
    CASE WHEN l_linenumber = 3 OR tax = '0.05' THEN NULL
         WHEN tax = '0.02' THEN CAST({fixed('coalesce(v, 1.0) * 1.03', 8)} AS DOUBLE)
         WHEN tax = '0.03' THEN CAST({fixed('coalesce(v, 1.0) * 1.2', 8)} AS DOUBLE)
         WHEN tax = '0.04' THEN CAST({fixed('coalesce(v, 1.0) * 100', 8)} AS DOUBLE) / 100
         ELSE CAST({fixed('coalesce(v, 1.0)', 8)} AS DOUBLE) END AS a
  FROM lines),
status AS (
  SELECT *, CASE WHEN l_linenumber = 3 THEN value_text ELSE CAST(g AS VARCHAR) END AS gold_exe_ans,
    CASE WHEN l_linenumber = 3 THEN true WHEN l_linenumber = 7 THEN false
         ELSE abs(v - g) <= greatest(1e-4 * abs(g), 1e-4) END AS executor_matches_gold,
    CASE WHEN l_linenumber = 3 THEN 'boolean' WHEN a IS NULL THEN 'non_numeric'
         WHEN abs(g - a) <= greatest(0.01 * abs(a), 5e-4)
           OR (tax = '0.04' AND abs(g - a * 100) <= greatest(0.01 * abs(a * 100), 5e-4)) THEN 'consistent'
         WHEN abs(g - a) <= greatest(0.05 * abs(a), 5e-3)
           OR (tax = '0.04' AND abs(g - a * 100) <= greatest(0.05 * abs(a * 100), 5e-3)) THEN 'rounding'
         ELSE 'conflict' END AS label_status,
    CASE l_returnflag WHEN 'R' THEN 'table+text' WHEN 'A' THEN 'table' ELSE 'text' END AS evidence_type,
    CASE l_returnflag WHEN 'R' THEN doc_id || '#table_1;' || doc_id || '#text_0' WHEN 'A' THEN doc_id || '#table_3'
                      ELSE doc_id || '#text_1' END AS gold_unit_ids,
    CASE WHEN l_linenumber IN (1, 4) THEN 2 WHEN l_linenumber = 5 THEN 3 ELSE 1 END AS n_steps
  FROM audit)"""

PROGRAM = f"""CASE l_linenumber WHEN 1 THEN 'multiply(' || {fixed('l_extendedprice')} || ', ' || {fixed('l_discount')} || '), subtract(' || {fixed('l_extendedprice')} || ', #0)'
  WHEN 2 THEN 'divide(' || {fixed('l_extendedprice')} || ', ' || {fixed('l_quantity')} || ')'
  WHEN 3 THEN 'greater(' || {fixed('l_quantity')} || ', 25), EOF'
  WHEN 4 THEN 'table_max(total price, none), divide(#0, const_100)'
  WHEN 5 THEN 'table_average(total price, none), exp(' || {fixed('l_quantity')} || ', 2), add(#0, #1)'
  WHEN 6 THEN 'add(' || {fixed('l_quantity')} || ', ' || {fixed('l_discount')} || '%)'
  ELSE CASE l_returnflag WHEN 'R' THEN 'divide(' || {fixed('l_extendedprice')} || ', 0)' WHEN 'A' THEN 'add(#1, 2)'
       ELSE 'table_sum(missing row, none)' END END"""

# The lines whose program works and whose id occurs once, as a load lets pass.
LOADABLE = LINES.replace("lines AS (", "every_line AS (") + """,
lines AS (SELECT * FROM every_line WHERE l_linenumber < 7 QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1)"""

MONEY = f"'$ ' || {fixed('o_totalprice')}"
PAGES = f"""pages_ AS (SELECT DISTINCT doc_id, ticker, fiscal_year, page, split, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM lines),
text_ AS (
  SELECT doc_id, 0 AS position, 'order ' || o_orderkey || ' was placed on ' || strftime(o_orderdate, '%Y-%m-%d') || ' .' AS text FROM pages_
  UNION ALL SELECT doc_id, 1, 'its priority is ' || lower(o_orderpriority) || ' .' FROM pages_
  UNION ALL SELECT doc_id, 2, 'amounts in dollars .' FROM pages_),
rows_ AS (
  SELECT doc_id, 0 AS position, ' | amount: amount | col_2: ' AS text, '' AS row_label, ';amount; ' AS cells FROM pages_
  UNION ALL SELECT doc_id, 1, 'total price | amount: ' || {MONEY} || ' | col_2: 100%', 'total price', 'total price;' || {MONEY} || ';100%' FROM pages_
  UNION ALL SELECT doc_id, 2, 'status | amount: ' || o_orderstatus, 'status ', 'status ;' || o_orderstatus FROM pages_
  UNION ALL SELECT doc_id, 3, 'Total Price | amount: ' || {MONEY} || ' ( net ) | col_2: n/a', 'Total Price ', 'Total Price ;' || {MONEY} || ' ( net );n/a' FROM pages_)"""

ORDERS = {
    "order_documents": with_([LINES, PAGES], "SELECT doc_id, ticker, fiscal_year, page, split, 3 AS n_text_units, 4 AS n_table_rows FROM pages_"),
    "json_round_trip": with_([LINES, PAGES], "SELECT doc_id, ticker, fiscal_year, page, 3 AS n_text_units, 4 AS n_table_rows FROM pages_"),
    "table_row_units": with_([LINES, PAGES], "SELECT doc_id || '#table_' || position AS unit_id, doc_id, position, text, row_label, ';amount; ' AS header, cells FROM rows_"),
    "units_union": with_([LINES, PAGES], """SELECT doc_id || '#text_' || position AS unit_id, doc_id, 'text' AS kind, text FROM text_
UNION ALL SELECT doc_id || '#table_' || position, doc_id, 'table_row', text FROM rows_"""),
    "train_units": with_([LINES, PAGES], """SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
SELECT 'text' AS kind, doc_id FROM text_ UNION ALL SELECT 'table_row', doc_id FROM rows_) JOIN pages_ USING (doc_id) WHERE split = 'train' GROUP BY kind"""),
    "json_lineage": with_([LINES], """SELECT doc_id || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, doc_id AS filename, '' AS split,
'c0ffee' AS _source_commit, 'run-1' AS _run_id, true AS from_json, true AS stamped FROM lines"""),
    "table_writes": """SELECT shape, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE round(o_totalprice * 2, 2) END AS o_totalprice, o_orderstatus,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS written, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS added, 3 AS version
FROM orders, (VALUES ('flat'), ('partitioned')) s(shape)""",
    "file_manifest": r"""SELECT coalesce(regexp_extract(url, '([a-z_]+)\.html$', 1), '') AS split, string_split(url, '/')[-1] AS name, sha256(html) AS sha256,
octet_length(encode(html)) AS bytes, 'c0ffee' AS source_commit FROM pages""",
    "json_arrays": with_([LINES, AUDIT], f"""SELECT question_id AS id, doc_id AS filename, split, {PROGRAM} AS program, 4 AS n_rows, split || '.json' AS file FROM status"""),
    "load_twice": with_([LOADABLE, AUDIT], """SELECT question_id, split, label_status, 3 AS n_text_units, 4 AS n_table_rows, 7 AS n_units,
(SELECT count(*) FROM status) AS bronze_rows, 'created;merged' AS outcome, 'run-1' AS run_ids FROM status"""),
    "report_sink": with_([LINES, AUDIT], """SELECT split, count(*) AS questions, count(DISTINCT doc_id) AS documents, count(DISTINCT ticker) AS tickers,
round(avg(executor_matches_gold::INT), 4) AS executor_agreement, count(*) FILTER (label_status = 'consistent') AS consistent FROM status GROUP BY split"""),
    "bucketed_upsert": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE round(o_totalprice * 2, 2) END AS o_totalprice, 'F' AS o_orderstatus,
'merged' AS outcome, 2 AS version FROM orders""",
    "evidence_type": with_([LINES, AUDIT], "SELECT question_id, evidence_type, gold_unit_ids, n_steps FROM status"),
    "program_values": with_([LINES, AUDIT], """SELECT question_id, round(v, 6) AS value_num, value_text, program_err,
CASE WHEN l_linenumber < 7 THEN n_steps ELSE 0 END AS n_results,
CASE WHEN l_linenumber IN (4, 5) THEN 'ambiguous_row:total price:2_matches' ELSE '' END AS warnings FROM status"""),
    "program_errors": with_([LINES, AUDIT], "SELECT coalesce(program_err, 'none') AS program_err, count(*) AS n FROM status GROUP BY 1"),
    "label_status": with_([LINES, AUDIT], "SELECT question_id, split, gold_exe_ans, executor_matches_gold, label_status FROM status"),
    "questions": with_([LINES, AUDIT], f"""SELECT question_id, doc_id, split,
'what is the value of line ' || l_linenumber || ' for part ' || l_partkey || ' ?' AS question,
{PROGRAM} AS gold_program,
gold_exe_ans, gold_unit_ids, evidence_type, n_steps, value_text AS executor_value, executor_matches_gold, label_status FROM status"""),
    "quality_metrics": with_([LINES, AUDIT], """SELECT count(*) AS questions, count(*) - count(DISTINCT question_id) AS duplicate_ids,
round(avg(executor_matches_gold::INT), 6) AS agreement, count(*) AS bronze_rows,
(SELECT count(*) FROM (SELECT doc_id FROM lines GROUP BY doc_id HAVING count(DISTINCT split) > 1)) AS leaked_pages FROM status"""),
    "quality_gate": with_([LINES, AUDIT], """SELECT 'not_empty' AS "check", count(*)::DOUBLE AS observed, count(*) > 0 AS passed FROM status
UNION ALL SELECT 'row_count', ((SELECT count(*) FROM status) - (SELECT count(*) FROM lines))::DOUBLE, (SELECT count(*) FROM status) = (SELECT count(*) FROM lines)
UNION ALL SELECT 'unique_ids', (count(*) - count(DISTINCT question_id))::DOUBLE, count(*) = count(DISTINCT question_id) FROM status
UNION ALL SELECT 'split_leak', count(*)::DOUBLE, count(*) = 0 FROM (SELECT doc_id FROM lines GROUP BY doc_id HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'agreement', round(avg(executor_matches_gold::INT), 4), avg(executor_matches_gold::INT) >= 0.999 FROM status"""),
    "status_histogram": with_([LINES, AUDIT], "SELECT label_status, count(*) AS n FROM status GROUP BY 1"),
    "audit_counts": with_([LINES, AUDIT], "SELECT split, label_status, count(*) AS n FROM status GROUP BY 1, 2"),
    "quality_report": with_([LINES, AUDIT], """SELECT split, 'questions' AS item, count(*)::DOUBLE AS value FROM status GROUP BY split
UNION ALL SELECT split, 'documents', count(DISTINCT doc_id) FROM status GROUP BY split
UNION ALL SELECT split, 'tickers', count(DISTINCT ticker) FROM status GROUP BY split
UNION ALL SELECT split, 'executor_agreement', round(avg(executor_matches_gold::INT), 4) FROM status GROUP BY split
UNION ALL SELECT split, 'label_status:' || label_status, count(*) FROM status GROUP BY split, label_status
UNION ALL SELECT split, 'evidence_type:' || evidence_type, count(*) FROM status GROUP BY split, evidence_type"""),
    "upsert": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE round(o_totalprice * 2, 2) END AS o_totalprice FROM orders""",
}

# ---------- programs and numbers over lineitem ----------

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
NUMBERS = {
    "parse_numbers": f"""WITH t AS (SELECT {KEY}, l_extendedprice AS p, CASE WHEN l_returnflag = 'R' THEN '$ ' || {fixed('l_extendedprice')} || ' ( ' || {fixed('l_extendedprice')} || ' )'
  WHEN l_returnflag = 'A' THEN ' -' || {fixed('l_extendedprice')} || ' % ' WHEN l_linenumber > 3 THEN {fixed('l_extendedprice')} || 'e1' ELSE 'n/a' END AS text, l_returnflag AS f FROM lineitem)
SELECT {KEY}, text, round(CASE WHEN f = 'R' THEN p WHEN f = 'A' THEN -p / 100 WHEN l_linenumber > 3 THEN p END, 6) AS cell,
round(CASE WHEN f = 'A' THEN -p / 100 WHEN f = 'N' AND l_linenumber > 3 THEN p * 10 END, 6) AS number FROM t""",
    "program_arith": f"""WITH t AS (SELECT *, l_extendedprice - l_extendedprice * l_discount AS net FROM lineitem),
u AS (SELECT *, net + net * l_tax AS v FROM t)
SELECT {KEY}, round(v, 6) AS value_num, CAST(v AS VARCHAR) AS value_text, CAST(NULL AS VARCHAR) AS program_err FROM u""",
    "program_overflow": f"""SELECT {KEY}, CAST(NULL AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS value_text, 'non_finite' AS program_err FROM lineitem""",
    "program_greater": f"""SELECT {KEY}, CAST(NULL AS DOUBLE) AS value_num, CASE WHEN l_extendedprice / l_quantity > 1000 THEN 'yes' ELSE 'no' END AS value_text,
CAST(NULL AS VARCHAR) AS program_err FROM lineitem""",
    "program_table_ops": f"""WITH t AS (SELECT *, l_extendedprice AS p, -l_quantity AS q, l_tax / 100 AS x FROM lineitem),
u AS (SELECT *, (greatest(p, q, x) + least(p, q, x)) - ((0.0::DOUBLE + p + q + x) + (0.0::DOUBLE + p + q + x) / 3) AS v FROM t)
SELECT {KEY}, round(v, 6) AS value_num, CAST(v AS VARCHAR) AS value_text, CAST(NULL AS VARCHAR) AS program_err FROM u""",
    "numbers_match": f"""WITH t AS (SELECT *, l_extendedprice AS p, l_extendedprice * (1.0::DOUBLE + l_discount / 5) AS o FROM lineitem)
SELECT {KEY}, abs(p - o) <= greatest(0.01::DOUBLE * abs(o), 0.005::DOUBLE) AS default_match, abs(o - p) <= greatest(0.005::DOUBLE * abs(p), 0.0::DOUBLE) AS tight_match,
abs(p / 100 - o) <= greatest(0.01::DOUBLE * abs(o), 0.005::DOUBLE) AS scaled_match,
(abs(p / 100 - o) <= greatest(0.01::DOUBLE * abs(o), 0.005::DOUBLE) OR abs(p / 100 - o * 100) <= greatest(0.01::DOUBLE * abs(o * 100), 0.005::DOUBLE)
 OR abs(p / 100 - o / 100) <= greatest(0.01::DOUBLE * abs(o / 100), 0.005::DOUBLE)) AS percent_match,
lower(l_returnflag) = lower(l_linestatus) AS text_match FROM t""",
}

# ---------- documents ----------

DOC = "source || '/' || n_chars || '/page_' || doc_id"
KEPT = f"list_filter({toks('{}')}, lambda t: t NOT IN ({STOP}))"
DOCS = f"""docs AS (SELECT doc_id AS number, {DOC} AS doc, lang, string_split(text, chr(10)) AS l FROM documents),
units AS (SELECT doc AS doc_id, doc || '#text_' || (i - 1) AS unit_id, CAST(i - 1 AS INTEGER) AS position, l[i] AS text
          FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM docs)),
corpus AS (SELECT unit_id FROM units),
gold AS (SELECT u.doc_id || '-1' AS question_id, unit_id, text FROM units u JOIN docs ON doc = u.doc_id
         WHERE position > 0 AND list_has_any({KEPT.replace('{}', 'text')}, {KEPT.replace('{}', 'l[1]')})),
kinds AS (SELECT question_id, CASE WHEN bool_and(contains(text, '|')) THEN 'table' WHEN bool_or(contains(text, '|')) THEN 'table+text' ELSE 'text' END AS evidence_type FROM gold GROUP BY 1),
questions AS (SELECT doc || '-1' AS question_id, doc AS doc_id, doc || '#text_0' AS own_unit_id, lang AS split, l[1] AS question, evidence_type,
       CASE WHEN toxic = 1 THEN 'boolean' WHEN quality = 1 THEN 'consistent' WHEN quality = 0 THEN 'conflict' ELSE 'non_numeric' END AS label_status
  FROM docs JOIN kinds ON kinds.question_id = doc || '-1' LEFT JOIN labels ON labels.doc_id = number)"""

TURNS = """numbered_ AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
units AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, conv_id || '#text_' || turn AS unit_id, text FROM conversations),
corpus AS (SELECT unit_id FROM units),
asked AS (SELECT conv_id, q, turn, text, conv_id || '-' || turn AS question_id FROM numbered_ WHERE role = 'user'),
gold AS (SELECT question_id, n.conv_id || '#text_' || n.turn AS unit_id FROM numbered_ n JOIN asked USING (conv_id, q) WHERE n.role = 'assistant'),
ends AS (SELECT conv_id, q, arg_max(role, turn) AS last_role, count(*) FILTER (role = 'assistant') AS answers FROM numbered_ GROUP BY ALL),
questions AS (SELECT question_id, CAST(conv_id AS VARCHAR) AS doc_id, conv_id || '#text_' || turn AS own_unit_id, 'test' AS split, text AS question,
       CASE WHEN answers > 1 THEN 'table+text' ELSE 'text' END AS evidence_type, CASE WHEN last_role = 'assistant' THEN 'consistent' ELSE 'conflict' END AS label_status
  FROM asked JOIN ends USING (conv_id, q) WHERE answers > 0)"""

ORDER_PAGES = """units AS (SELECT doc_id, doc_id || '#text_' || position AS unit_id, text FROM text_
  UNION ALL SELECT doc_id, doc_id || '#table_' || position, text FROM rows_),
corpus AS (SELECT unit_id FROM units),
once AS (SELECT * FROM status QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY evidence_type, label_status) = 1),
gold AS (SELECT question_id, unnest(string_split(gold_unit_ids, ';')) AS unit_id FROM once ),
questions AS (SELECT question_id, doc_id, NULL AS own_unit_id, split, 'what is the value of line ' || l_linenumber || ' for part ' || l_partkey || ' ?' AS question, evidence_type, label_status FROM once)"""

STEM = """CASE WHEN t LIKE '%ies' AND NOT (t LIKE '%eies' OR t LIKE '%aies') THEN left(t, length(t) - 3) || 'y'
  WHEN t LIKE '%es' AND NOT (t LIKE '%aes' OR t LIKE '%ees' OR t LIKE '%oes') THEN left(t, length(t) - 1)
  WHEN t LIKE '%s' AND NOT (t LIKE '%us' OR t LIKE '%ss') THEN left(t, length(t) - 1) ELSE t END"""


def english(words: str) -> list[str]:
    """CTEs up to ``stems_(term, stem)`` for the words of a query that gives ``term``: a table per step of the algorithm."""
    def found(suffixes) -> str:
        return f"regexp_extract(w, '{stems.ending(suffixes)}')"

    def exchanged(suffixes: dict[str, str], region: str, allowed: str) -> str:
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in suffixes.items())
        return (f"SELECT term, r1, r2, CASE WHEN f <> '' AND length(rest) >= {region} AND ({allowed}) THEN rest || CASE f {cases} END ELSE w END AS w "
                f"FROM (SELECT *, left(w, length(w) - length(f)) AS rest FROM (SELECT *, {found(suffixes)} AS f FROM {{}}))")

    has = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"
    begins = f"^(?:{'|'.join(stems.BEGINNINGS)})"
    first = f"CASE WHEN {has('w', begins)} THEN length(regexp_extract(w, '{begins}')) WHEN {has('w', stems.REGION)} THEN length(regexp_extract(w, '{stems.REGION}')) ELSE length(w) END"
    last = "left(x, length(x) - 1)"
    return [
        f"terms_ AS ({words})",
        f"""marked_ AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '({stems.VOWEL})y', '\\1Y', 'g') AS w FROM terms_)""",
        f"region_ AS (SELECT *, {first} AS r1 FROM marked_)",
        f"""regions_ AS (SELECT term, r1, r1 + CASE WHEN {has('rest', stems.REGION)} THEN length(regexp_extract(rest, '{stems.REGION}')) ELSE length(rest) END AS r2, w
  FROM (SELECT *, substr(w, r1 + 1) AS rest FROM region_))""",
        f"""singular_ AS (SELECT term, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
  WHEN {has('w', '(?:ied|ies)$')} THEN left(w, length(w) - 3) || CASE WHEN length(w) > 4 THEN 'i' ELSE 'ie' END
  WHEN {has('w', '(?:us|ss)$')} THEN w WHEN {has('w', stems.VOWEL + '.+s$')} THEN left(w, length(w) - 1) ELSE w END AS w FROM regions_)""",
        f"""past_ AS (SELECT term, r1, r2, w AS before, CASE WHEN f IN ('eed', 'eedly') THEN CASE WHEN length(x) >= r1 THEN x || 'ee' ELSE w END
  WHEN f = '' OR NOT {has('x', stems.VOWEL)} THEN w
  WHEN {has('x', '(?:at|bl|iz)$')} OR ({has('x', stems.SHORT)} AND length(x) <= r1 AND NOT {has('x', stems.DOUBLE)}) THEN x || 'e'
  WHEN {has('x', stems.DOUBLE)} THEN {last} ELSE x END AS w
  FROM (SELECT *, left(w, length(w) - length(f)) AS x FROM (SELECT *, regexp_extract(w, '(?:eedly|eed|edly|ed|ingly|ing)$') AS f FROM singular_)))""",
        f"ys_ AS (SELECT term, r1, r2, CASE WHEN {has('w', '^.+' + stems.OTHER + '[yY]$')} THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM past_)",
        "two_ AS (" + exchanged(stems.STEP_2, "r1", f"CASE f WHEN 'ogi' THEN ends_with(rest, '{stems.BEFORE_OGI}') WHEN 'li' THEN {has('rest', stems.BEFORE_LI + '$')} ELSE true END").format("ys_") + ")",
        "three_ AS (" + exchanged(stems.STEP_3, "r1", "f <> 'ative' OR length(rest) >= r2").format("two_") + ")",
        "four_ AS (" + exchanged(dict.fromkeys(stems.STEP_4, ""), "r2", f"f <> 'ion' OR {has('rest', stems.BEFORE_ION + '$')}").format("three_") + ")",
        f"""five_ AS (SELECT term, CASE WHEN (ends_with(w, 'e') AND (length(x) >= r2 OR (length(x) >= r1 AND NOT {has('x', stems.SHORT)}))) OR (ends_with(w, 'll') AND length(x) >= r2)
  THEN x ELSE w END AS w FROM (SELECT *, left(w, length(w) - 1) AS x FROM four_))""",
        f"""stems_ AS (SELECT term, CASE {' '.join(f"WHEN term = '{a}' THEN '{b}'" for a, b in stems.IRREGULAR.items())}
  WHEN length(term) <= 2 OR term IN ({', '.join(f"'{w}'" for w in stems.UNCHANGED)}) OR NOT {has('term', '^[a-z]+$')} THEN term
  WHEN before IN ({', '.join(f"'{w}'" for w in stems.UNCHANGED_SINGULAR)}) THEN before ELSE lower(w) END AS stem FROM five_ JOIN (SELECT term, lower(before) AS before FROM past_) USING (term))""",
    ]


ENGLISH_WORDS = f"SELECT DISTINCT t AS term FROM (SELECT unnest({toks('text')}) AS t FROM units UNION ALL SELECT unnest({toks('question')}) FROM questions)"


def scoring(configs, stem: str = STEM, stemmed_by: str = "") -> list[str]:
    """CTEs up to ``scored(config_id, question_id, unit_id, score)`` for the units and questions CTEs before them. ``stem`` is the stem of
    ``t``, from a table joined by ``stemmed_by``."""
    rows = ", ".join(
        f"({i}, {c.variant}, '{c.idf_scope}', {float(c.k1)}::DOUBLE, {float(c.b)}::DOUBLE)" for i, c in enumerate(configs))
    variants = ", ".join(f"({v}, {bool(v & 2)}, {bool(v & 1)})" for v in sorted({c.variant for c in configs}))
    return [
        f"configs(config_id, variant, scope, k1, b) AS (VALUES {rows})",
        f"variants(variant, stem, stop) AS (VALUES {variants})",
        f"utok AS (SELECT doc_id, unit_id, unnest({toks('text')}) AS t FROM units)",
        f"qtok AS (SELECT question_id, doc_id, unnest({toks('question')}) AS t FROM questions)",
        f"uterm AS (SELECT variant, doc_id, unit_id, CASE WHEN variants.stem THEN {stem} ELSE t END AS term FROM utok {stemmed_by} CROSS JOIN variants WHERE NOT (stop AND t IN ({STOP})))",
        f"qterm AS (SELECT DISTINCT variant, question_id, doc_id, CASE WHEN variants.stem THEN {stem} ELSE t END AS term FROM qtok {stemmed_by} CROSS JOIN variants WHERE NOT (stop AND t IN ({STOP})))",
        "tf AS (SELECT variant, doc_id, unit_id, term, count(*) AS tf FROM uterm GROUP BY ALL)",
        "dl AS (SELECT v.variant, u.doc_id, u.unit_id, coalesce(sum(tf.tf), 0) AS dl FROM units u CROSS JOIN variants v "
        "LEFT JOIN tf ON tf.unit_id = u.unit_id AND tf.variant = v.variant GROUP BY ALL)",
        "candidates AS (SELECT question_id, doc_id, unit_id FROM questions JOIN units USING (doc_id) WHERE unit_id IS DISTINCT FROM own_unit_id)",
        "sizes AS (SELECT variant, question_id, count(*) AS n, CASE WHEN sum(dl) > 0 THEN sum(dl)::DOUBLE / count(*) ELSE 1.0 END AS avgdl "
        "FROM candidates JOIN dl USING (unit_id) GROUP BY ALL)",
        "page_df AS (SELECT variant, question_id, term, count(*) AS df FROM qterm JOIN candidates USING (question_id) JOIN tf USING (variant, unit_id, term) GROUP BY ALL)",
        "all_df AS (SELECT variant, term, count(*) AS df FROM tf WHERE unit_id IN (SELECT unit_id FROM corpus) GROUP BY ALL)",
        "all_n AS (SELECT count(*) AS n FROM corpus)",
        """hits AS (SELECT c.config_id, q.question_id, tf.unit_id, q.term, tf.tf::DOUBLE AS tf, dl.dl::DOUBLE AS dl, s.avgdl, c.k1, c.b,
  CASE c.scope WHEN 'page' THEN s.n ELSE all_n.n END::DOUBLE AS n, CASE c.scope WHEN 'page' THEN page_df.df ELSE coalesce(all_df.df, 0) END::DOUBLE AS df
  FROM configs c JOIN qterm q ON q.variant = c.variant JOIN candidates p ON p.question_id = q.question_id
  JOIN tf ON tf.variant = c.variant AND tf.unit_id = p.unit_id AND tf.term = q.term
  JOIN dl ON dl.variant = c.variant AND dl.unit_id = tf.unit_id JOIN sizes s ON s.variant = c.variant AND s.question_id = q.question_id
  JOIN page_df ON page_df.variant = c.variant AND page_df.question_id = q.question_id AND page_df.term = q.term
  LEFT JOIN all_df ON all_df.variant = c.variant AND all_df.term = q.term CROSS JOIN all_n)""",
        """sums AS (SELECT config_id, question_id, unit_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * dl / avgdl)) ORDER BY term) AS score
  FROM hits GROUP BY ALL)""",
        """scored AS (SELECT c.config_id, q.question_id, q.unit_id, coalesce(s.score, 0) AS score
  FROM candidates q CROSS JOIN configs c
  LEFT JOIN sums s ON s.config_id = c.config_id AND s.question_id = q.question_id AND s.unit_id = q.unit_id)""",
    ]


RANKED = ["ranked AS (SELECT *, row_number() OVER (PARTITION BY config_id, question_id ORDER BY round(score, 9) DESC, sha1(unit_id)) AS rank FROM scored)"]


def gain(rank: str) -> str:
    return f"1 / log2({rank} + 1)"


def results() -> list[str]:
    """CTEs from ``ranked`` to ``results``: every metric and its expectation per configuration and question."""
    system = ["1.0 / min(rank) AS rr"]
    # C(a, b) as a logarithm, for any number of gold units
    choose = lambda x, y: f"(lgamma({x} + 1) - lgamma({y} + 1) - lgamma({x} - ({y}) + 1))"
    chance = [f"list_sum(list_transform(range(1, n - g + 2), lambda r: exp({choose('n - r', 'g - 1')} - {choose('n', 'g')}) / r)) AS random_rr"]
    for k in KS:
        ideal = f"list_sum(list_transform(range(1, least({{g}}, {k}) + 1), lambda i: {gain('i')}))"
        kk = f"least(n, {k})"
        system += [
            f"sum((rank <= {k})::INT)::DOUBLE / count(*) AS recall_at_{k}", f"(max(rank) <= {k})::INT::DOUBLE AS all_gold_at_{k}",
            f"sum(CASE WHEN rank <= {k} THEN {gain('rank')} ELSE 0 END) / {ideal.format(g='count(*)')} AS ndcg_at_{k}"]
        chance += [
            f"{kk}::DOUBLE / n AS random_recall_at_{k}",
            f"CASE WHEN g > {kk} THEN 0.0 ELSE exp({choose(kk, 'g')} - {choose('n', 'g')}) END AS random_all_gold_at_{k}",
            f"g * list_sum(list_transform(range(1, {kk} + 1), lambda i: {gain('i')})) / n / {ideal.format(g='g')} AS random_ndcg_at_{k}"]
    return [
        "sized AS (SELECT config_id, question_id, count(*) AS n FROM ranked GROUP BY ALL)",
        "top AS (SELECT config_id, question_id, string_agg(unit_id, ';' ORDER BY rank) AS top_unit_ids FROM ranked WHERE rank <= 10 GROUP BY ALL)",
        f"system AS (SELECT config_id, question_id, count(*) AS g, string_agg(rank::VARCHAR, ';' ORDER BY rank) AS gold_ranks, {', '.join(system)} "
        "FROM ranked JOIN gold USING (question_id, unit_id) GROUP BY ALL)",
        f"results AS (SELECT q.*, s.* EXCLUDE (question_id), n AS n_candidates, CAST(g AS INTEGER) AS n_gold, top_unit_ids, {', '.join(chance)} "
        "FROM system s JOIN sized USING (config_id, question_id) JOIN top USING (config_id, question_id) JOIN questions q USING (question_id))",
    ]


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def avg6(*names: str) -> str:
    return ", ".join(f"round(avg({n}), 6) AS {n}" for n in names)


GRID = bm25_grid()
PAGE, CORPUS = [c for c in GRID if c.stopwords and not c.stem]
ONE = [DOCS, *scoring([PAGE])]
EVERY = [DOCS.replace("FROM docs JOIN kinds", "FROM docs LEFT JOIN kinds"), *scoring([PAGE])]  # documents without gold lines ask too
EVAL = [*ONE, *RANKED, *results()]
EVAL_TWO = [DOCS, *scoring([PAGE, CORPUS]), *RANKED, *results()]
EVAL_GRID = [DOCS, *scoring(GRID), *RANKED, *results()]
EVAL_ENGLISH = [DOCS, *english(ENGLISH_WORDS), *scoring(GRID, "stems_.stem", "JOIN stems_ ON stems_.term = t"), *RANKED, *results()]
EVAL_ORDERS = [LINES, AUDIT, PAGES, ORDER_PAGES, *scoring([PAGE]), *RANKED, *results()]
EVAL_TURNS = [TURNS, *scoring([PAGE]), *RANKED, *results()]
EVAL_DEV = [LOADABLE, AUDIT, PAGES, ORDER_PAGES.replace("corpus AS (SELECT unit_id FROM units)", "corpus AS (SELECT unit_id FROM units JOIN pages_ USING (doc_id) WHERE split = 'train')")
            .replace("FROM once)", "FROM once WHERE split = 'dev')"), *scoring([PAGE, CORPUS]), *RANKED, *results()]
RANDOM = tuple(f"random_{m}" for m in METRICS)
def mixed(x: str) -> str:
    """``x`` (below 2**32) spread over all numbers below 2**32."""
    for _ in range(2):
        x = f"((xor({x}, ({x}) // 65536) * {bootstrap.MULTIPLIER}) % 4294967296)"
    return f"xor({x}, {x} // 65536)"


def at(m: str, q: float) -> str:
    """The value at a share of the replicates."""
    return f"list_sort(list({m}))[1 + CAST(round_even({q!r}::DOUBLE * (count(*) - 1), 0) AS INTEGER)]"


def interval(metrics) -> list[str]:
    parts = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, (SELECT avg({m}) FROM vals) AS mean, {at(m, 0.025)} AS low, {at(m, 0.975)} AS high FROM means"
        for m in metrics)
    return [f"interval_ AS ({parts})"]


TREE = [
    "asked AS (SELECT DISTINCT question_id, ('0x' || substr(md5(question_id), 1, 8))::BIGINT AS number FROM vals)",
    f"""tree AS (SELECT count(*) AS n, CASE WHEN count(*) < {bootstrap.LEAF} THEN 0 ELSE CAST(floor(log2(count(*) // {bootstrap.LEAF})) AS BIGINT) END AS depth FROM asked)""",
    """placed AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY question_id) - 1 AS place, count(*) OVER (PARTITION BY node) AS m
  FROM (SELECT question_id, depth, (number >> (32 - depth)) + (1::BIGINT << depth) AS node FROM asked, tree))""",
    "sizes_ AS (SELECT node >> l AS node, count(*) AS size FROM placed, range(40) r(l) WHERE l <= depth GROUP BY 1)",
    f"""states AS (SELECT replicate, {mixed('x')} AS state FROM (SELECT range AS replicate, (range * {bootstrap.MULTIPLIER}) % 4294967296 AS x FROM range({bootstrap.N_BOOT})))""",
    f"""reached AS (WITH RECURSIVE down AS (
    SELECT replicate, state, 1::BIGINT AS node, n::BIGINT AS d FROM states, tree
    UNION ALL
    SELECT replicate, state, below, CASE WHEN below % 2 = 0 THEN share ELSE d - share END
    FROM (SELECT *, unnest([2 * node, 2 * node + 1]) AS below,
             least(d, greatest(0, CAST(floor(d * p + sqrt(-2.0::DOUBLE * ln((first + 1)::DOUBLE / 4294967296)) * cos(second::DOUBLE / 4294967296 * (2 * pi())) * sqrt(d * p * (1 - p)) + 0.5::DOUBLE) AS BIGINT))) AS share
          FROM (SELECT *, {mixed('y')} AS second FROM (SELECT *, (first + {bootstrap.SECOND}) % 4294967296 AS y
          FROM (SELECT *, {mixed('x')} AS first FROM (SELECT replicate, state, d.node, d, coalesce(l.size, 0)::DOUBLE / s.size AS p, (state + d.node * {bootstrap.STRIDE}) % 4294967296 AS x
             FROM down d JOIN sizes_ s ON s.node = d.node LEFT JOIN sizes_ l ON l.node = 2 * d.node JOIN tree ON d.node < (1::BIGINT << depth))))))
  ) SELECT * FROM down)""",
    f"""picked AS (SELECT replicate, node, m, {mixed('z')} * m // 4294967296 AS place FROM (
    SELECT *, (own + draw * {bootstrap.DRAW}) % 4294967296 AS z FROM (
      SELECT replicate, node, m, {mixed('x')} AS own, unnest(range(1, d + 1)) AS draw FROM (
        SELECT r.*, m, (state + r.node * {bootstrap.STRIDE}) % 4294967296 AS x FROM reached r JOIN (SELECT DISTINCT node, m FROM placed) USING (node)))))""",
    "drawn AS (SELECT replicate, question_id, count(*) AS w FROM picked JOIN placed USING (node, place) GROUP BY ALL)",
]


def weighted(keys: str, metrics) -> list[str]:
    """CTEs from ``vals(question_id, <keys>, <metrics>)`` to the mean of each replicate: as many draws as questions, split down a tree."""
    return [
        *TREE,
        f"means AS (SELECT {keys} replicate, {', '.join(f'sum({m} * w) / sum(w) AS {m}' for m in metrics)} FROM drawn JOIN vals USING (question_id) GROUP BY ALL)",
    ]


def weights(source: str, metrics) -> list[str]:
    return [f"vals AS ({source})", *weighted("", metrics), *interval(metrics)]


def _breakdown() -> str:
    columns = avg6(*HEADLINE, *[f"random_{m}" for m in HEADLINE])
    dims = {"evidence_type": "evidence_type", "n_gold": "CASE WHEN n_gold < 3 THEN n_gold::VARCHAR ELSE '3+' END", "label_status": "label_status"}
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {e} AS value, count(*) AS n, {columns} FROM results GROUP BY 2" for d, e in dims.items())


def _run_rows() -> str:
    params = f"CASE config_id WHEN 0 THEN '{PAGE.params_json}' ELSE '{CORPUS.params_json}' END"
    columns = avg6("all_gold_at_5", "random_all_gold_at_5")
    dims = {"all": "'all'", "evidence_type": "evidence_type", "n_gold": "CASE WHEN n_gold < 3 THEN n_gold::VARCHAR ELSE '3+' END", "label_status": "label_status"}
    return " UNION ALL ".join(
        f"SELECT {params} AS params_json, 'all' AS split, 'bm25' AS retriever, '{{\"documents\":0}}' AS silver_versions_json, '{d}' AS dimension, "
        f"{e} AS value, count(*) AS n, {columns} FROM results GROUP BY config_id, {'1' if d == 'all' else e}" for d, e in dims.items())


COMPARED = ("all_gold_at_5", "ndcg_at_10", "recall_at_3")
_PAIRED = "SELECT question_id, " + ", ".join(f"p.{m} - c.{m} AS {m}" for m in COMPARED) + \
    " FROM results p JOIN results c USING (question_id) WHERE p.config_id = 0 AND c.config_id = 1"


def _compare() -> str:
    ctes = [*EVAL_GRID,
            "best AS (SELECT config_id FROM results GROUP BY config_id ORDER BY round(avg(all_gold_at_5), 12) DESC, config_id LIMIT 1)",
            "vals AS (SELECT r.config_id, r.question_id, " + ", ".join(f"r.{m} - b.{m} AS {m}" for m in COMPARED) +
            " FROM results r JOIN results b USING (question_id) WHERE b.config_id = (SELECT config_id FROM best) AND r.config_id <> b.config_id)",
            *weighted("config_id,", COMPARED)]
    parts = " UNION ALL ".join(
        f"SELECT (SELECT config_id FROM best) AS best_config_id, config_id, '{m}' AS metric, "
        f"round((SELECT avg({m}) FROM vals v WHERE v.config_id = means.config_id), 6) AS diff, "
        f"round({at(m, 0.025)}, 6) AS low, round({at(m, 0.975)}, 6) AS high FROM means GROUP BY config_id" for m in COMPARED)
    return with_(ctes, parts)


def _report() -> str:
    head = "SELECT question_id, " + ", ".join(HEADLINE) + " FROM results"
    random = " UNION ALL ".join(f"SELECT '{m}' AS metric, avg(random_{m}) AS random FROM results" for m in HEADLINE)
    return with_([*EVAL, *weights(head, HEADLINE), f"random_ AS ({random})"],
                 f"SELECT metric, round(mean, 6) AS system, {r6('low', 'high', 'random')} FROM interval_ JOIN random_ USING (metric)")


_HEAD = "SELECT question_id, " + ", ".join(HEADLINE) + " FROM results"
_INTERVAL = f"SELECT metric, {r6('mean', 'low', 'high')} FROM interval_"

DOCUMENTS = {
    "documents_profile": with_([DOCS], """SELECT d.doc AS doc_id, source AS ticker, CAST(n_chars AS INTEGER) AS fiscal_year, 'page_' || documents.doc_id AS page,
documents.lang AS split, CAST(len(l) AS INTEGER) AS n_text_units, 0 AS n_table_rows FROM docs d JOIN documents ON documents.doc_id = number"""),
    "text_units": with_([DOCS], "SELECT doc_id, unit_id, position, text FROM units"),
    "page_dedupe": """WITH copies AS (SELECT sha256(text) AS page, source AS split, len(string_split(text, chr(10))) AS n,
row_number() OVER (PARTITION BY text ORDER BY source, CAST(doc_id AS VARCHAR)) AS rn FROM documents)
SELECT page, split, CAST(n AS INTEGER) AS n_text_units FROM copies WHERE rn = 1""",
    "split_leak": """SELECT sha256(text) AS filename, min(source) AS first_split, max(source) AS last_split FROM documents GROUP BY text
HAVING count(DISTINCT source) > 1""",
    "duplicate_keys": "SELECT sha256(text) AS text_hash, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "tokens": f"""WITH every AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents
UNION ALL SELECT 'turn', conv_id || '-' || turn, text FROM conversations), cut AS (SELECT kind, id, {toks('text')} AS w FROM every)
SELECT kind, id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_filter(w, lambda t: t NOT IN ({STOP}))) AS INTEGER) AS n_kept,
md5(array_to_string(w, ' ')) AS token_hash FROM cut""",
    "stem_map": f"SELECT t AS term, {STEM} AS stem FROM (SELECT DISTINCT unnest({toks('text')}) AS t FROM documents)",
    "page_term_df": with_(ONE, "SELECT question_id, term, df FROM page_df"),
    "page_sizes": with_(ONE, f"SELECT question_id, n, {r6('avgdl')} FROM sizes"),
    "corpus_term_df": with_(ONE, "SELECT term, df FROM all_df"),
    "bm25_page": with_(EVERY, f"SELECT question_id, unit_id, {r6('score')} FROM scored"),
    "bm25_train_corpus": with_([DOCS.replace("corpus AS (SELECT unit_id FROM units)", "corpus AS (SELECT unit_id FROM units JOIN docs ON doc = doc_id WHERE lang = 'en')")
                               .replace("questions AS (SELECT", "questions AS (SELECT * FROM (SELECT") + " WHERE split <> 'en')", *scoring([CORPUS])],
                               f"SELECT question_id, unit_id, {r6('score')} FROM scored"),
    "bm25_corpus": with_([DOCS, *scoring([CORPUS])], f"SELECT question_id, unit_id, {r6('score')} FROM scored"),
    "ranking_full": with_([*EVERY, *RANKED], "SELECT question_id, unit_id, rank FROM ranked"),
    "ranking_top10": with_(EVAL, "SELECT question_id, top_unit_ids FROM results"),
    "ranking_checks": with_([DOCS, """pairs AS (SELECT *, contains(text, '|') AS bar FROM questions JOIN units USING (doc_id) WHERE unit_id IS DISTINCT FROM own_unit_id)"""], """SELECT 'scored' AS "check", count(*) AS n FROM pairs
UNION ALL SELECT 'whole_gaps', count(*) FROM pairs WHERE unit_id IS NULL
UNION ALL SELECT 'whole_rankings', count(*) FROM questions WHERE question_id NOT IN (SELECT question_id FROM pairs)
UNION ALL SELECT 'whole_missing_gold', count(*) FROM gold WHERE unit_id NOT IN (SELECT unit_id FROM units)
UNION ALL SELECT 'broken_gaps', (SELECT count(*) FROM pairs WHERE bar OR position = 1) + (SELECT count(*) FROM questions)
UNION ALL SELECT 'broken_rankings', count(*) FROM questions
UNION ALL SELECT 'broken_missing_gold', count(*) FROM questions"""),
    "gold_ranks": with_(EVAL, "SELECT question_id, n_candidates, gold_ranks FROM results"),
    "rank_metrics": with_(EVAL, f"SELECT question_id, {r6(*METRICS)} FROM results"),
    "expected_random": with_(EVAL, f"SELECT question_id, n_candidates, n_gold, {r6(*RANDOM)} FROM results"),
    "question_results": with_(EVAL, f"""SELECT question_id, doc_id, split, evidence_type, label_status, n_candidates, n_gold, gold_ranks, top_unit_ids,
{r6('rr', 'ndcg_at_10', 'random_rr')} FROM results"""),
    "run_summary": with_(EVAL, f"SELECT count(*) AS n_questions, {avg6(*METRICS, *RANDOM)} FROM results"),
    "breakdown": with_(EVAL, _breakdown()),
    "english_stems": with_([DOCS, *english(f"SELECT DISTINCT unnest({toks('text')}) AS term FROM units")], "SELECT term, stem FROM stems_"),
    "grid_summary": with_(EVAL_ENGLISH, f"SELECT config_id, count(*) AS n_questions, {avg6('all_gold_at_5', 'recall_at_5', 'rr', 'ndcg_at_10')} FROM results GROUP BY config_id"),
    "bootstrap_ci": with_([*EVAL, *weights(_HEAD, HEADLINE)], _INTERVAL),
    "bootstrap_weights": with_([*EVAL, "vals AS (SELECT question_id FROM results)", *TREE],
                               "SELECT CAST(replicate AS INTEGER) AS replicate, CAST(sum(w) AS BIGINT) AS draws, count(*) AS n_drawn, max(w) AS most FROM drawn GROUP BY replicate"),
    "paired_bootstrap": with_([*EVAL_TWO, *weights(_PAIRED, COMPARED)], _INTERVAL),
    "compare_to_best": _compare(),
    "report": _report(),
    "order_rank_metrics": with_(EVAL_ORDERS, f"SELECT question_id, {r6(*METRICS)} FROM results"),
    "order_question_results": with_(EVAL_ORDERS, f"""SELECT question_id, doc_id, split, evidence_type, label_status, n_candidates, n_gold, gold_ranks, top_unit_ids,
{r6('rr', 'ndcg_at_10', 'random_rr')} FROM results"""),
    "run_rows": with_(EVAL_TWO, _run_rows()),
    "evaluation_run": with_(EVAL_DEV, f"""SELECT CASE config_id WHEN 0 THEN 'page' ELSE 'corpus' END AS run_id, question_id, split, n_candidates, gold_ranks,
{r6('rr', 'random_ndcg_at_5')}, count(*) OVER (PARTITION BY config_id) AS n_questions FROM results"""),
    "conversation_metrics": with_(EVAL_TURNS, f"SELECT question_id, evidence_type, label_status, n_candidates, n_gold, gold_ranks, {r6(*METRICS)} FROM results"),
    "conversation_summary": with_(EVAL_TURNS, f"SELECT count(*) AS n_questions, {avg6(*METRICS, *RANDOM)} FROM results"),
}

ORACLE: dict[str, str] = {**ORDERS, **NUMBERS, **DOCUMENTS}
