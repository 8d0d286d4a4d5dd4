"""Queries of text preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera import params
from tessera.functions import text as T
from tessera.plans import base
from tessera.session import shared_dir
from tessera.sources import io

Q, SQL = {}, {}
_D = base.with_(base.DOCS)
C = F.col


def _docs(s, d):
    return base.docs(s, d)


Q["a1_scan_submissions"] = lambda s, d: io.scan_submissions(_docs(s, d), "src3").select("batch", "doc", F.length("text").cast("long").alias("n"))
SQL["a1_scan_submissions"] = _D + "SELECT batch, doc, length(text) AS n FROM docs WHERE batch = 'src3'"


def _files(s, d):
    r = _docs(s, d)
    return r.select("batch", "doc", (F.length("text") * 4000).cast("long").alias("length"), F.encode(F.when(C("doc") % 4 == 0, "text").otherwise("%PDF"), "UTF-8").alias("magic"))


Q["a2_validate_files"] = lambda s, d: _files(s, d).select("doc", F.coalesce(io.file_problem(C("length"), C("magic")), F.lit("ok")).alias("status"))
SQL["a2_validate_files"] = _D + "SELECT doc, CASE WHEN length(text) * 4000 > 10485760 THEN 'too_large' WHEN doc % 4 = 0 THEN 'not_pdf' ELSE 'ok' END AS status FROM docs"

Q["a3_content_hash"] = lambda s, d: io.content_groups(_docs(s, d), "text").select("batch", "doc", "content_hash", "n_same", "stored_path")
SQL["a3_content_hash"] = _D + """, h AS (SELECT batch, doc, sha256(text) AS content_hash FROM docs)
SELECT batch, doc, content_hash, count(*) OVER (PARTITION BY batch, content_hash) AS n_same, batch || '/' || content_hash || '.pdf' AS stored_path FROM h"""

_ODD = "concat('ﬁne ', chr(8203), 'x', chr(173), chr(8206), text)"
Q["b1_sanitize"] = lambda s, d: T.sanitized(_docs(s, d).select("doc", F.concat(F.lit("ﬁne \u200bx\u00ad\u200e"), "text").alias("t")), "t").select("doc", F.md5("t").alias("h"))
SQL["b1_sanitize"] = _D + "SELECT doc, md5('fine x' || nfc_normalize(text)) AS h FROM docs"

Q["b2_strip_markdown"] = lambda s, d: (
    _docs(s, d).select("doc", T.strip_markdown(F.concat(F.lit("![i](a.png) [label "), C("doc").cast("string"), F.lit("](http://x.y) "), "text")).alias("t")).select("doc", F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))
)
SQL["b2_strip_markdown"] = _D + r""", t AS (SELECT doc, regexp_replace(regexp_replace('![i](a.png) [label ' || doc || '](http://x.y) ' || text, '!\[.*?\]\(.*?\)', '', 'g'), '\[(.*?)\]\(.*?\)', '\1', 'g') AS t FROM docs)
SELECT doc, length(t) AS n, md5(t) AS h FROM t"""


def _cover(s, d):
    k = C("doc").cast("string")
    head = (
        F.when(C("doc") % 4 == 0, F.concat(F.lit("Student ID: UG-"), k, F.lit("\nStudent Name: Ada Lee "), k, F.lit(" Roll: 7\n")))
        .when(C("doc") % 4 == 1, F.concat(F.lit("ID: X"), k, F.lit("\nName: Bo Chan | Section B\n")))
        .when(C("doc") % 4 == 2, F.concat(F.lit("Nr 2024-1-60-"), F.lpad(k, 3, "0"), F.lit("\nCourse Name: Algorithms\n")))
        .otherwise(F.lit("Student ID: section\nStudent Name: Lab Report\n"))
    )
    return _docs(s, d).select("doc", F.concat(head, "text").alias("cover"))


_COVER = """, c AS (SELECT doc, substring(CASE doc % 4 WHEN 0 THEN 'Student ID: UG-' || doc || chr(10) || 'Student Name: Ada Lee ' || doc || ' Roll: 7' || chr(10)
  WHEN 1 THEN 'ID: X' || doc || chr(10) || 'Name: Bo Chan | Section B' || chr(10) WHEN 2 THEN 'Nr 2024-1-60-' || lpad(CAST(doc AS VARCHAR), 3, '0') || chr(10) || 'Course Name: Algorithms' || chr(10)
  ELSE 'Student ID: section' || chr(10) || 'Student Name: Lab Report' || chr(10) END || text, 1, 3000) AS head FROM docs)"""


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_found(text: str, pattern: str) -> str:
    return f"nullif(trim(regexp_extract({text}, {_lit(pattern)}, 1)), '')"


_WORDS = "[" + ", ".join(f"'{w}'" for w in params.NOT_AN_ID) + "]"
Q["b3_student_id"] = lambda s, d: _cover(s, d).select("doc", T.student_id(C("cover")).alias("student_id"))
SQL["b3_student_id"] = _D + _COVER + f""", f AS (SELECT doc, {_sql_found('head', T.LABELLED_ID)} AS one, {_sql_found('head', T.PLAIN_ID)} AS two, {_sql_found('head', T.BARE_ID)} AS three FROM c)
SELECT doc, coalesce(CASE WHEN NOT list_contains({_WORDS}, lower(one)) AND (regexp_matches(one, '[0-9]') OR length(one) >= 3) THEN one END,
  CASE WHEN NOT list_contains({_WORDS}, lower(two)) AND regexp_matches(two, '[0-9]') THEN two END, three) AS student_id FROM f"""
Q["b4_student_name"] = lambda s, d: _cover(s, d).select("doc", T.student_name(C("cover")).alias("student_name"))
_NO_OTHER = r"regexp_replace(head, '(?i)\b(Program|Project|Course|File|Assignment|Lab|Topic|Subject|Function|Class)(\s)Name', '\1\2N-ame', 'g')"
SQL["b4_student_name"] = _D + _COVER + rf""", f AS (SELECT doc, coalesce({_sql_found('head', T.LABELLED_NAME)},
  {_sql_found(_NO_OTHER, r"(?i)\bName\s*[:\-\s=]+\s*([^\r\n]{2,80})")}) AS raw FROM c),
g AS (SELECT doc, regexp_replace(regexp_split_to_array(raw, {_lit(T.NAME_END)})[1], '^[ :\-–\t]+|[ :\-–\t]+$', '', 'g') AS name FROM f)
SELECT doc, CASE WHEN length(name) >= 2 AND NOT coalesce(list_has_any(regexp_extract_all(lower(name), '\b([a-z]+)\b', 1), {_WORDS}), false) THEN name END AS student_name FROM g"""

_CODE = "intro line\ndef f(x):\n    return x\n\nplain one\nplain two\nplain three\nint y = {k};\n```py\nprint({k})\n```\nlast"


def _coded(s, d):
    return _docs(s, d).select("doc", F.replace(F.lit(_CODE), F.lit("{k}"), C("doc").cast("string")).alias("t"), "text")


_T = ", t AS (SELECT doc, replace(('{}'), '{{k}}', CAST(doc AS VARCHAR)) || chr(10) || text AS t FROM docs)".format(_CODE.replace("\n", "' || chr(10) || '"))
Q["b5_fenced_code"] = lambda s, d: _coded(s, d).select("doc", F.array_join(T.fenced_code(F.concat_ws("\n", "t", "text")), "|").alias("fenced"), F.length(T.without_fences(F.concat_ws("\n", "t", "text"))).cast("long").alias("n"))
SQL["b5_fenced_code"] = _D + _T + f" SELECT doc, array_to_string(regexp_extract_all(t, {_lit(T.FENCE)}, 1), '|') AS fenced, length(regexp_replace(t, {_lit(T.FENCE)}, '', 'g')) AS n FROM t"

Q["b6_code_lines"] = lambda s, d: _coded(s, d).select("doc", F.explode(F.split(F.concat_ws("\n", "t", "text"), "\n")).alias("l")).groupBy("doc").agg(F.count_if(T.is_code_line(C("l"))).alias("n_code"), F.count("*").alias("n"))
_marks = " OR ".join(["contains(l, '{}')".format(m) for m in params.CODE_MARKS] + [f"ends_with(trim(l), '{e}')" for e in params.CODE_ENDS] + [f"starts_with(trim(l), '{x}')" for x in params.CODE_STARTS])
SQL["b6_code_lines"] = _D + ", t AS (SELECT doc, replace('{}', '{{k}}', CAST(doc AS VARCHAR)) || chr(10) || text AS t FROM docs), l AS (SELECT doc, unnest(string_split(t, chr(10))) AS l FROM t)\n".format(_CODE.replace("\n", "' || chr(10) || '")).replace("replace('", "replace(('", 1).replace("last', '{k}'", "last'), '{k}'", 1) + (
    f"SELECT doc, count(*) FILTER (WHERE {_marks} OR ((starts_with(l, '    ') OR starts_with(l, chr(9))) AND NOT regexp_matches(trim(l), '^[*#-]'))) AS n_code, count(*) AS n FROM l GROUP BY 1"
)

# after the code come the whole text's letters in one line, and the same backwards in another: whether they look like code decides what they belong to
_plain = lambda: F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
Q["b7_segment_code"] = lambda s, d: (
    _coded(s, d).select("doc", T.split_code(F.concat_ws("\n", "t", _plain(), F.reverse(_plain()))).alias("r"))
    .select("doc", C("r.prose").alias("prose"), F.array_join("r.blocks", "#").alias("blocks"))
)
_LETTER_MARKS = "(" + " OR ".join("contains({0}, '%s')" % m for m in params.CODE_MARKS if m.replace(" ", "").isalpha()) + ")"
SQL["b7_segment_code"] = _D + f""", p AS (SELECT doc, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS x, reverse(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))) AS y FROM docs),
q AS (SELECT *, x = '' OR {_LETTER_MARKS.format('x')} OR {_LETTER_MARKS.format('y')} AS kept FROM p)
SELECT doc, 'intro line' || chr(10) || 'plain three' || CASE WHEN kept THEN '' ELSE chr(10) || y END AS prose, 'print(' || doc || ')' || chr(10) || '#def f(x):' || chr(10) || '    return x' || chr(10) || chr(10)
  || 'plain one' || chr(10) || 'plain two#int y = ' || doc || ';' || chr(10) || chr(10) || 'last' || CASE WHEN x = '' THEN '' ELSE chr(10) || x END || CASE WHEN kept AND x <> '' THEN chr(10) || y ELSE '' END AS blocks FROM q"""

Q["b8_merge_blocks"] = lambda s, d: (
    _docs(s, d).select("doc", F.md5("text").alias("h"), F.regexp_extract("text", "([A-Za-z]+)", 1).alias("f"))
    .select("doc", T.merge_blocks(F.when(C("doc") % 2 == 0, F.array("f", "h")), F.when(C("doc") % 3 == 0, F.array(C("h"), F.lit("c"), C("f")))).alias("m"))
    .select("doc", F.array_join("m", ",").alias("merged"), C("m").isNotNull().alias("has_code"))
)
SQL["b8_merge_blocks"] = _D + """, h AS (SELECT doc, md5(text) AS h, regexp_extract(text, '([A-Za-z]+)', 1) AS f FROM docs)
SELECT doc, CASE WHEN doc % 6 = 0 THEN f || ',' || h || CASE WHEN f = 'c' THEN '' ELSE ',c' END WHEN doc % 2 = 0 THEN f || ',' || h WHEN doc % 3 = 0 THEN h || ',c' || CASE WHEN f = 'c' THEN '' ELSE ',' || f END END AS merged,
  doc % 2 = 0 OR doc % 3 = 0 AS has_code FROM h"""

Q["b9_parse_status"] = lambda s, d: _docs(s, d).groupBy(T.parse_status(F.when(C("doc") % 10 == 0, F.lit("  ")).when(C("doc") % 10 != 1, C("text"))).alias("status")).agg(F.count("*").alias("n"))
SQL["b9_parse_status"] = _D + "SELECT CASE WHEN doc % 10 IN (0, 1) OR trim(text) = '' THEN 'parse_error' ELSE 'ok' END AS status, count(*) AS n FROM docs GROUP BY 1"

STOP = "[" + ", ".join(f"'{w}'" for w in params.STOP_WORDS) + "]"
TOKENS = f"tok AS (SELECT batch, doc, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+') AND NOT list_contains({STOP}, w)) AS w FROM docs)"
Q["b10_content_tokens"] = lambda s, d: _docs(s, d).select("doc", T.content_tokens(C("text")).alias("w")).select("doc", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("h"))
SQL["b10_content_tokens"] = base.with_(base.DOCS, TOKENS) + "SELECT doc, len(w) AS n, md5(array_to_string(w, ' ')) AS h FROM tok"

SENT, STYLE = base.SENT, base.STYLE
Q["b11_sentences"] = lambda s, d: _docs(s, d).select("doc", T.sentences(C("text")).alias("s")).select("doc", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("h"))
SQL["b11_sentences"] = base.with_(base.DOCS, SENT) + "SELECT doc, len(s) AS n, md5(array_to_string(s, '|')) AS h FROM sent"

Q["b12_text_profile"] = lambda s, d: _docs(s, d).select("doc", T.text_profile(C("text")).alias("p")).select("doc", "p.n_words", "p.n_chars", "p.n_paragraphs", "p.n_shown")
SQL["b12_text_profile"] = _D + r""", p AS (SELECT doc, text, list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: length(trim(x)) > 0) AS a, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS b FROM docs),
q AS (SELECT doc, text, CASE WHEN len(a) > 1 THEN len(a) ELSE len(b) END AS n FROM p)
SELECT doc, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words, length(text) AS n_chars, n AS n_paragraphs, least(n, 40) AS n_shown FROM q"""

Q["b13_safe_name"] = lambda s, d: _docs(s, d).select("doc", T.safe_name(F.when(C("doc") % 2 == 0, F.concat(F.lit("A b/"), "student_id")), F.md5(C("doc").cast("string"))).alias("name"))
SQL["b13_safe_name"] = _D + "SELECT doc, CASE WHEN doc % 2 = 0 THEN 'A_b_' || student_id ELSE substring(md5(CAST(doc AS VARCHAR)), 1, 8) END AS name FROM docs"

Q["e3_stylometric"] = lambda s, d: _docs(s, d).select("doc", F.round(T.stylometric(C("text")), 6).alias("stylometric"))
SQL["e3_stylometric"] = base.with_(base.DOCS, SENT, STYLE) + "SELECT doc, round(stylometric, 6) AS stylometric FROM stylometric"

Q["e4_stylometric_features"] = lambda s, d: _docs(s, d).select("doc", T.stylometric_features(C("text")).alias("f")).select("doc", F.round("f.ttr", 3).alias("ttr"), "f.avg_sent_len", "f.punct_density")
SQL["e4_stylometric_features"] = base.with_(base.DOCS, SENT) + r""", f AS (SELECT doc, text, s, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+')) AS w, length(text) - length(regexp_replace(text, '[.,;:!?]', '', 'g')) AS np FROM sent),
g AS (SELECT *, len(w) > 0 AND len(s) > 0 AS ok FROM f)
SELECT doc, CASE WHEN ok THEN round(CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS DOUBLE) / len(w), 3) ELSE 0.0 END AS ttr, CASE WHEN ok THEN round(CAST(len(w) AS DOUBLE) / len(s), 2) ELSE 0.0 END AS avg_sent_len,
  CASE WHEN ok THEN round(CAST(np AS DOUBLE) / greatest(length(text), 1), 3) ELSE 0.0 END AS punct_density FROM g"""


def _rewritten(s, d):
    """All documents' lengths by batch, written twice: the second run, over the batches with an annotation by number, adds 1000 to each of theirs."""
    path = f"{shared_dir(s)}/rewritten-{uuid.uuid4().hex}"
    rows = _docs(s, d).select("batch", "doc", F.length("text").cast("long").alias("n"))
    io.overwrite_batches(rows, path)
    for _ in range(2):  # a rerun changes nothing
        io.overwrite_batches(rows.where(F.md5("batch") < "8").withColumn("n", C("n") + 1000), path)
    return s.read.schema(rows.schema).parquet(path).select("batch", "doc", "n")


Q["a11_overwrite_batches"] = _rewritten
SQL["a11_overwrite_batches"] = _D + "SELECT batch, doc, length(text) + CASE WHEN md5(batch) < '8' THEN 1000 ELSE 0 END AS n FROM docs"


def _featured(s, d):
    """All documents as a labelled CSV, read again; then their features as CSV."""
    path = f"{shared_dir(s)}/labelled-{uuid.uuid4().hex}"
    rows = _docs(s, d).select("text", (C("doc") % 2).cast("int").alias("label"))
    rows.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(f"{path}/in")
    io.write_features(io.scan_labelled_csv(s, f"{path}/in"), f"{path}/out", T.stylometric_features)
    out = s.read.csv(f"{path}/out", header=True, schema="ttr double, avg_sent_len double, punct_density double, stylometric_score double, label int")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("punct_density"), 4).alias("punct_density"))


Q["a5_labelled_csv"] = _featured
SQL["a5_labelled_csv"] = base.with_(base.DOCS, SENT, STYLE) + r"""SELECT CAST(doc % 2 AS INTEGER) AS label, count(*) AS n, round(avg(CASE WHEN regexp_matches(text, '(^|[^\pL\pN_])[a-zA-Z]+($|[^\pL\pN_])') THEN round(np / length(text), 3) ELSE 0 END), 4) AS punct_density
FROM style JOIN stylometric USING (doc, batch) WHERE stylometric IS NOT NULL GROUP BY 1"""
