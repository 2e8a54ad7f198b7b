"""Repeated lines by a log-template tree: token count, leading tokens, then templates with a generalised field.

A line's tokens are cut by white space; a token that holds a digit is a field. The tree has fixed depth: the first level
is the number of tokens, the next ones are the leading tokens. In a leaf, the tokens behind the leading ones are cut
into four spans of equal length, and a template keeps two spans and generalises the others, so that lines which differ
in up to two spans share one. Lines with fewer than `least` tokens have one template, all their tokens.

A template that two documents or more have recurs. It proposes a line; whether the line goes is decided by comparing it
with the first line of its template:

* a line all of whose tokens are fields never goes;
* a line with the tokens and fields of an earlier document's line goes;
* a line that differs from it in fields only goes if `often` documents have its template and at least half of its tokens
  are not fields: a form filled in again and again, not two statements with numbers of their own;
* a line of `least` tokens or more that differs in other tokens goes if its fields are equal and at least `alike` percent
  of the other tokens are; not if that first line goes by this rule itself.

Only built-in functions run: hashes of templates are shuffled, and only for leaves that hold two documents; the tokens
of two lines are laid side by side only where a template proposes a line that is not a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

BLANKS = "[ \\t\\x0B\\f\\r]"
SOLID = "[^ \\t\\x0B\\f\\r]"
SPANS = 4
KEPT = [(i, j) for i in range(SPANS) for j in range(i + 1, SPANS)]


FIELD = f"(?<!{SOLID})[^ \\t\\x0B\\f\\r0-9]*+[0-9]{SOLID}*"


def line_tokens(line: Column) -> Column:
    """Tokens of a line, fields masked; an empty array for a blank line."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, "<*>")).otherwise(line)
    bare = F.btrim(masked, F.lit(" \t\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{BLANKS}+"))


def field_tokens(line: Column) -> Column:
    """The fields of a line."""
    return F.when(line.rlike("[0-9]"), F.regexp_extract_all(line, F.lit(FIELD), F.lit(0))).otherwise(F.array().cast("array<string>"))


def template_hashes(docs: DataFrame, lead: int, least: int) -> DataFrame:
    """One row per line that has a token other than a field: doc_id, pos, n and n_fields (tokens and fields), leaf, whole
    (hash of the tokens), fields (hash of the fields) and, from `least` tokens on, parts (hashes of its spans)."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("doc_id", "pos", line_tokens(F.col("line")).alias("t"), F.xxhash64(field_tokens(F.col("line"))).alias("fields"), F.col("line").rlike("[0-9]").alias("digits"))
    rows = rows.withColumn("n", F.size("t")).withColumn("n_fields", F.when(F.col("digits"), F.size("t") - F.size(F.array_remove("t", "<*>"))).otherwise(0)).where("n > n_fields")
    rest = F.col("n") - lead
    bounds = [F.lit(lead) + F.floor(rest * j / SPANS).cast("int") for j in range(SPANS + 1)]
    spans = F.array(*(F.xxhash64(F.slice("t", bounds[j] + 1, bounds[j + 1] - bounds[j])) for j in range(SPANS)))
    return rows.select("doc_id", "pos", "n", "n_fields", F.xxhash64("n", F.slice("t", 1, lead)).alias("leaf"), F.xxhash64("t").alias("whole"), "fields",
                       F.when(F.col("n") >= least, spans).alias("parts"))


def recurring(rows: DataFrame, key: str) -> DataFrame:
    """Keys found in two documents, with the first line of each."""
    first = F.min(F.struct("doc_id", "pos", "fields")).alias("first")
    return rows.groupBy(key).agg(first, F.max("doc_id").alias("last")).where("first.doc_id < last").select(key, "first")


def line_words(docs: DataFrame, wanted: DataFrame, most_sent: int) -> DataFrame:
    """(doc_id, pos, t) of the wanted lines, read from the documents again. The wanted places are sent to every task if
    they were counted to be `most_sent` numbers at most."""
    places = written(wanted.groupBy("doc_id").agg(F.collect_set("pos").alias("wanted")), "wanted")
    few = (places.agg(F.sum(F.size("wanted") + 4)).first()[0] or 0) <= most_sent
    rows = docs.join(F.broadcast(places) if few else places, "doc_id").withColumn("__cut", F.split("text", "\n"))
    rows = rows.select("doc_id", F.explode("wanted").alias("pos"), "__cut").select("doc_id", "pos", F.get("__cut", F.col("pos")).alias("line"))
    # rows of one id are one document: of lines at one place, the least by its text stands for all
    return rows.where("line IS NOT NULL").groupBy("doc_id", "pos").agg(F.min("line").alias("line")).select("doc_id", "pos", line_tokens(F.col("line")).alias("t"))


def near_lines(docs: DataFrame, shared: DataFrame, gone: DataFrame, alike: int, most_sent: int) -> DataFrame:
    """(doc_id, pos) of lines that are like the first of a template in all fields and most other tokens."""
    rows = shared.where("parts IS NOT NULL")
    templates = F.array(*(F.xxhash64("leaf", F.lit(i * SPANS + j), F.get("parts", F.lit(i)), F.get("parts", F.lit(j))) for i, j in KEPT))
    keyed = rows.select("doc_id", "pos", "fields", "whole", F.explode(templates).alias("template"))
    late = keyed.join(written(recurring(keyed, "template"), "templates"), "template").where("first.doc_id < doc_id AND first.fields = fields")
    pairs = late.select("doc_id", "pos", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")).distinct()
    pairs = written(pairs.join(gone, ["doc_id", "pos"], "left_anti"), "proposed")
    # hot first lines: a join of written tables, so that they can be split
    asked = pairs.select("doc_id", "pos").unionByName(pairs.select(F.col("first_doc").alias("doc_id"), F.col("first_pos").alias("pos"))).distinct()
    words = written(line_words(docs, asked, most_sent), "words")
    firsts = words.select(F.col("doc_id").alias("first_doc"), F.col("pos").alias("first_pos"), F.col("t").alias("first"))
    side = pairs.join(words, ["doc_id", "pos"]).join(firsts, ["first_doc", "first_pos"])
    field = F.lit("<*>")
    plain = F.size(F.filter(F.arrays_zip("t", "first"), lambda x: (x["t"] != field) | (x["first"] != field)))
    equal = F.size(F.filter(F.arrays_zip("t", "first"), lambda x: (x["t"] == x["first"]) & (x["t"] != field)))
    alike_pairs = written(side.where(100 * equal >= alike * plain).select("doc_id", "pos", "first_doc", "first_pos"), "alike")
    # what is like a line that goes itself may be too far from the one that stays
    going = written(alike_pairs.select(F.col("doc_id").alias("first_doc"), F.col("pos").alias("first_pos")).distinct(), "going")
    return alike_pairs.join(going, ["first_doc", "first_pos"], "left_anti").select("doc_id", "pos").distinct()


def dropped_lines(docs: DataFrame, lead: int, least: int, often: int, alike: int, most_sent: int) -> DataFrame:
    """doc_id, dropped: the places of a document's lines that go."""
    lines = written(template_hashes(docs, lead, least), "lines")
    # the sides of a join are tables of their own, so that a key with very many lines can be split
    shared = written(lines.join(written(recurring(lines, "leaf").select("leaf"), "leaves"), "leaf"), "shared-lines")
    exact = shared.withColumn("raw", F.xxhash64("whole", "fields"))
    copies = exact.join(written(recurring(exact, "raw"), "repeated"), "raw").where("first.doc_id < doc_id").select("doc_id", "pos")
    forms = shared.where("n_fields > 0 AND 2 * n_fields <= n").select("doc_id", "pos", "fields", "whole")
    known = forms.groupBy("whole").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= often).select("whole", "first")
    filled = forms.join(written(known, "forms"), "whole").where("first < doc_id").select("doc_id", "pos")
    gone = written(copies.unionByName(filled).distinct(), "copies")
    near = written(near_lines(docs, shared, gone, alike, most_sent), "near-lines")
    return gone.unionByName(near).groupBy("doc_id").agg(F.collect_set("pos").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, lead: int = 2, least: int = 8, often: int = 3, alike: int = 90, most_sent: int = 4_000_000, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """All columns of `docs`, the text without its repeated lines, and n_lines, n_dropped (long).

    The places of dropped lines are sent to every task if they were counted to be at most `most_sent` numbers (16 MB);
    beyond that, documents and places are shuffled together.

    Blank lines stay. A null text stays null and has no lines; an empty one has one blank line. Rows of one id are one
    document: no line is dropped because of another row of the same id, but a line dropped at a place goes from all rows
    of that id. Rows without an id are neither changed nor counted. Columns of `docs` named n_lines or n_dropped are
    replaced. An empty table gives an empty one.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dropped = dropped_lines(plain, lead, least, often, alike, most_sent)
    gone = written(dropped.select(F.col("doc_id").alias("__id"), F.col("dropped").alias("__dropped")), "dropped")
    few = (gone.agg(F.sum(F.size("__dropped") + 4)).first()[0] or 0) <= most_sent
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*names).join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col("__id"), "left")
    joined = joined.withColumn("__cut", F.split(text_col, "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__cut") - 1), "__dropped")
    joined = joined.withColumn("__kept", F.when(F.col("__dropped").isNotNull(), places))
    kept = F.array_join(F.transform("__kept", lambda i: F.get("__cut", i)), "\n")
    text = F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(kept)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__cut"))
    n_dropped = F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__cut") - F.size("__kept"))
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in names), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


TWIN = """
WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
             FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
masked AS (SELECT doc_id, pos, trim(regexp_replace(line, '[^ \\t\\x0B\\f\\r0-9]*[0-9][^ \\t\\x0B\\f\\r]*', '<*>', 'g'), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare,
           array_to_string(regexp_extract_all(line, '[^ \\t\\x0B\\f\\r0-9]*[0-9][^ \\t\\x0B\\f\\r]*'), ' ') AS fields FROM cut),
tokens AS (SELECT doc_id, pos, fields, regexp_split_to_array(bare, '[ \\t\\x0B\\f\\r]+') AS t FROM masked WHERE bare <> ''),
sized AS (SELECT doc_id, pos, fields, t, len(t) AS n, len(list_filter(t, lambda x: x = '<*>')) AS n_fields, array_to_string(t, ' ') AS whole FROM tokens),
solid AS (SELECT *, array_to_string(t[1:2], ' ') AS head FROM sized WHERE n > n_fields),
copies AS (SELECT doc_id, pos FROM solid JOIN (SELECT whole, fields, min(doc_id) AS first FROM solid GROUP BY ALL) USING (whole, fields) WHERE first < doc_id),
filled AS (SELECT doc_id, pos FROM solid JOIN (SELECT whole, min(doc_id) AS first FROM solid GROUP BY whole HAVING count(DISTINCT doc_id) >= 3) USING (whole)
           WHERE n_fields > 0 AND 2 * n_fields <= n AND first < doc_id),
spans AS (SELECT *, list_transform([0, 1, 2, 3], lambda j: array_to_string(t[2 + ((n - 2) * j) // 4 + 1 : 2 + ((n - 2) * (j + 1)) // 4], ' ')) AS s FROM solid WHERE n >= 8),
keys AS (SELECT doc_id, pos, fields, t, unnest([
    concat_ws('|', n, head, '01', s[1], s[2]), concat_ws('|', n, head, '02', s[1], s[3]), concat_ws('|', n, head, '03', s[1], s[4]),
    concat_ws('|', n, head, '12', s[2], s[3]), concat_ws('|', n, head, '13', s[2], s[4]), concat_ws('|', n, head, '23', s[3], s[4])]) AS template FROM spans),
firsts AS (SELECT DISTINCT ON (template) template, doc_id AS first_doc, pos AS first_pos, fields AS first_fields, t AS first FROM keys ORDER BY template, doc_id, pos),
alike AS (SELECT doc_id, pos, first_doc, first_pos FROM keys JOIN firsts USING (template) WHERE first_doc < doc_id AND fields = first_fields
         AND 100 * len(list_filter(list_zip(t, first), lambda x: x[1] = x[2] AND x[1] <> '<*>')) >= 90 * len(list_filter(list_zip(t, first), lambda x: x[1] <> '<*>' OR x[2] <> '<*>')) AND (doc_id, pos) NOT IN (SELECT * FROM copies UNION SELECT * FROM filled)),
near AS (SELECT DISTINCT doc_id, pos FROM alike WHERE (first_doc, first_pos) NOT IN (SELECT doc_id, pos FROM alike)),
gone AS (SELECT * FROM copies UNION SELECT * FROM filled UNION SELECT * FROM near),
counted AS (SELECT c.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY c.pos) AS kept
            FROM cut c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.pos = g.pos GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN counted USING (doc_id)
"""
