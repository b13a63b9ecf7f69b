"""Named queries over the driver's tables, each over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.colors import format_hex, parse_hex
from quillspark.functions.strings import fuzzy_ratio
from quillspark.functions.templates import bind, key_path
from quillspark.operators import annotations, bookmarks, diff, docx_xml, forms, segmentation, spatial, templates
from quillspark.operators import pages as page_ops
from quillspark.operators import tokens as token_ops
from quillspark.sources import docx, layout
from quillspark.streaming import page_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def box_columns(prefix: str = "bounding_box") -> list[Column]:
    return [r6(F.col(f"{prefix}.{c}")).alias(c) for c in ("x", "y", "width", "height")]


# ---------------------------------------------------------------------------------- comparison


def second_version(words: Column) -> Column:
    """A fixed edit of a word list: every 11th word dropped, every 5th of six letters or more ends in q, every 7th begins with zz."""
    edited = F.transform(
        words,
        lambda w, i: F.when((i + 1) % 11 == 0, F.lit(None))
        .when(((i + 1) % 5 == 0) & (F.length(w) >= 6), F.concat(F.substr(w, F.lit(1), F.length(w) - 1), F.lit("q")))
        .when((i + 1) % 7 == 0, F.concat(F.lit("zz"), w))
        .otherwise(w),
    )
    return F.filter(edited, lambda w: w.isNotNull())


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.lit(0).alias("page_index"), F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words"))
    return rows, rows.withColumn("words", second_version(F.col("words")))


#: Characters outside ASCII that the texts have, and control characters that stand for them where DuckDB compares bytes.
ACCENTS, STAND_INS = "àáâäçèéêëíîïñóôöùúûüßœæÿ", "".join(map(chr, (*range(1, 9), *range(14, 30))))

SPLIT_SQL = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"

#: From pairs of word lists v(pid, a, b). r: a row of the table of common lengths each, and what the walk back does at its cells;
#: t: the walk from the last cell; o: its ops in order, with the words' places.
DIFF_SQL = """aw AS MATERIALIZED (SELECT pid, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM v), bw AS MATERIALIZED (SELECT pid, unnest(b) AS w, generate_subscripts(b, 1) AS j FROM v),
r AS (SELECT pid, 0 AS i, [CAST(0 AS INT) for x in range(0, len(b) + 1)] AS n, '' AS ds FROM v UNION ALL
  SELECT pid, i, n, list_aggregate([CASE WHEN a[i] = b[j] THEN 'E' WHEN n[j] >= up[j + 1] THEN 'I' ELSE 'D' END for j in range(1, len(b) + 1)], 'string_agg', '') FROM
    (SELECT pid, i, a, b, up, list_prepend(0, [list_max(c[1:j]) for j in range(1, len(b) + 1)]) AS n FROM
      (SELECT r.pid, r.i + 1 AS i, a, b, r.n AS up, [CASE WHEN a[r.i + 1] = b[j] THEN r.n[j] + 1 ELSE r.n[j + 1] END for j in range(1, len(b) + 1)] AS c FROM r JOIN v ON v.pid = r.pid AND r.i < len(a)))),
d AS MATERIALIZED (SELECT pid, i, ds FROM r WHERE i > 0),
t AS (SELECT pid, CAST(len(a) AS INT) AS i, CAST(len(b) AS INT) AS j, '' AS op, 0 AS step FROM v UNION ALL
  SELECT pid, CASE WHEN op = 'I' THEN i ELSE i - 1 END, CASE WHEN op = 'D' THEN j ELSE j - 1 END, op, step + 1 FROM
    (SELECT t.pid, t.i, t.j, step, CASE WHEN t.i > 0 AND t.j > 0 THEN ds[t.j] WHEN t.j > 0 THEN 'I' ELSE 'D' END AS op FROM t LEFT JOIN d ON d.pid = t.pid AND d.i = t.i WHERE t.i + t.j > 0)),
o AS MATERIALIZED (SELECT pid, -step AS pos, op, i + 1 AS i, j + 1 AS j FROM t WHERE step > 0)"""


@query(f"""WITH RECURSIVE w AS (SELECT conv_id * 1000 + turn AS pid, {SPLIT_SQL} AS a FROM conversations),
v AS MATERIALIZED (SELECT pid, a, list_filter(list_transform(a, lambda x, i: CASE WHEN i % 11 = 0 THEN NULL WHEN i % 5 = 0 AND length(x) >= 6 THEN left(x, length(x) - 1) || 'q' WHEN i % 7 = 0 THEN 'zz' || x ELSE x END), lambda x: x IS NOT NULL) AS b FROM w),
{DIFF_SQL}, g AS (SELECT *, sum(CASE WHEN op = 'E' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY pos) AS gap FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY pid, gap, op ORDER BY pos) AS k FROM g),
p AS (SELECT x.pid, x.gap, x.k, translate(aw.w, '{ACCENTS}', '{STAND_INS}') AS p, translate(bw.w, '{ACCENTS}', '{STAND_INS}') AS q
  FROM k x JOIN k y ON x.pid = y.pid AND x.gap = y.gap AND x.k = y.k AND x.op = 'D' AND y.op = 'I' JOIN aw ON aw.pid = x.pid AND aw.i = x.i JOIN bw ON bw.pid = y.pid AND bw.j = y.j),
z AS (SELECT pid, gap, k, CASE WHEN length(p) > 30 OR length(q) > 30 THEN 2.0 * len(list_filter(range(1, least(length(p), length(q)) + 1), lambda i: p[1:i] = q[1:i])) / (length(p) + length(q))
  ELSE 1.0 - levenshtein(p, q) / CAST(greatest(length(p), length(q)) AS DOUBLE) END > 0.8 AS alike FROM p),
c AS (SELECT pid, count(*) AS changed FROM (SELECT pid, bool_and(alike) OVER (PARTITION BY pid, gap ORDER BY k) AS ok FROM z) WHERE ok GROUP BY 1)
SELECT pid AS pair_id, 0 AS page_index1, 0 AS page_index2, CAST(count(*) FILTER (WHERE op = 'I') - coalesce(any_value(changed), 0) AS BIGINT) AS added,
  CAST(count(*) FILTER (WHERE op = 'D') - coalesce(any_value(changed), 0) AS BIGINT) AS deleted, CAST(coalesce(any_value(changed), 0) AS BIGINT) AS changed FROM o LEFT JOIN c USING (pid) GROUP BY pid""")
def diff_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two versions of each text, per page."""
    return diff.compare(*_versions(spark, sf_dir))


@query(f"""WITH RECURSIVE w AS (SELECT conv_id * 1000 + turn AS pid, conv_id, turn, {SPLIT_SQL} AS w FROM conversations),
v AS MATERIALIZED (SELECT x.pid, x.w AS a, coalesce(y.w, []) AS b FROM w x LEFT JOIN w y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1), {DIFF_SQL}
SELECT pid AS pair_id, count(*) FILTER (WHERE op = 'E') AS lcs, count(*) FILTER (WHERE op = 'D') AS only_old, count(*) FILTER (WHERE op = 'I') AS only_new FROM o GROUP BY 1""")
def diff_lcs_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the longest common word sequence of each turn and the next."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words"))
    old = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.lit(0).alias("page_index"), "words")
    new = t.where("turn > 0").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("pair_id"), F.lit(0).alias("page_index"), "words")
    ops = diff.diff_ops(diff.align_pages(old, new))
    return ops.groupBy("pair_id").agg(F.count_if(F.col("op") == "E").cast("bigint").alias("lcs"), F.count_if(F.col("op") == "D").cast("bigint").alias("only_old"), F.count_if(F.col("op") == "I").cast("bigint").alias("only_new"))


PAGES_SQL = "SELECT doc_id, unnest(range(0, CAST(ceil(len(string_split(text, chr(10))) / 63.0) AS BIGINT))) AS page_index FROM documents WHERE text IS NOT NULL"


@query(f"""
WITH p AS ({PAGES_SQL}), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1),
a AS (SELECT p.* FROM p JOIN n USING (doc_id) WHERE NOT (doc_id % 2 = 1 AND page_index = n - 1)),
b AS (SELECT p.* FROM p JOIN n USING (doc_id) WHERE NOT (doc_id % 3 = 1 AND page_index = n - 1))
SELECT coalesce(a.doc_id, b.doc_id) AS pair_id, CAST(coalesce(a.page_index, -1) AS INT) AS page_index1, CAST(coalesce(b.page_index, -1) AS INT) AS page_index2
FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.page_index = b.page_index
""")
def diff_page_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = layout.pages(table(spark, sf_dir, "documents")).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    p = p.select(F.col("doc_id").alias("pair_id"), "page_index", "n", F.array().cast("array<string>").alias("words"))
    last = F.col("page_index") == F.col("n") - 1
    a, b = (p.where(~((F.col("pair_id") % k == 1) & last)) for k in (2, 3))
    return diff.align_pages(a, b).select("pair_id", F.col("page_index1").cast("int").alias("page_index1"), F.col("page_index2").cast("int").alias("page_index2"))


@query(r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')), '\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id, unnest(range(1, len(w))) AS i, w FROM w), q AS (SELECT item_id, CAST(i AS INT) AS pos, w[i] AS a, w[i + 1] AS b FROM p)
SELECT item_id, pos, round(CASE WHEN a = b THEN 1.0 WHEN length(a) > 30 OR length(b) > 30
  THEN 2.0 * len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])) / (length(a) + length(b))
  ELSE 1.0 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END, 6) AS ratio FROM q
""")
def fuzzy_word_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    w = b.select("item_id", F.filter(F.split(F.lower(F.regexp_replace("text", "[^\\x00-\\x7F]", "x")), r"\s+"), lambda x: x != "").alias("w"))
    p = w.select("item_id", F.posexplode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, c: F.struct(a.alias("a"), c.alias("b")))).alias("pos", "p"))
    return p.select("item_id", (F.col("pos") + 1).alias("pos"), r6(fuzzy_ratio(F.col("p.a"), F.col("p.b"))).alias("ratio"))


# ---------------------------------------------------------------------------------- segmentation

GLYPHS_SQL = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents),
g AS (SELECT doc_id, l // 63 AS page_index, l % 63 AS line, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) - 1 AS k FROM l WHERE t <> ''),
c AS (SELECT doc_id, page_index, line * 10000000 + k AS seq, ch, 40.0 + 6 * k AS x, 40.0 + 12 * line + 6 * (line // 7) + 10 AS y,
  CASE (line // 7) % 3 WHEN 0 THEN 20e0 WHEN 1 THEN 155e-1 ELSE 10e0 END - CASE WHEN line % 2 = 0 THEN 1 ELSE 0 END AS size FROM g),
d AS (SELECT *, trim(ch) = '' AS blank, lag(x) OVER o AS px, lag(y) OVER o AS py FROM c WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY seq)),
i AS (SELECT *, sum(CASE WHEN blank OR coalesce(abs(y - py) > 5 OR x - (px + 6) > 2.4, FALSE) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id, page_index ORDER BY seq) AS island FROM d),
w AS (SELECT doc_id, page_index, island, string_agg(ch, '' ORDER BY seq) AS text, min(x) AS x0, min(y) AS y0, max(x) + 6 AS x1, min(size) AS size FROM i WHERE NOT blank GROUP BY 1, 2, 3),
b AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY island) - 1 AS block_seq, text, size,
  greatest(0, least(1, x0 / 595.0)) AS x, greatest(0, least(1, (y0 - 10) / 842.0)) AS y, greatest(0, least(1, (x1 - x0) / 595.0)) AS width, 10 / 842.0 AS height FROM w)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.words(layout.page_glyphs(layout.spread(table(spark, sf_dir, "documents"))), layout.PAGE_W, layout.PAGE_H)


@query(f"""WITH {GLYPHS_SQL}
SELECT doc_id, CAST(page_index AS INT) AS page_index, CAST(block_seq AS INT) AS block_seq, text, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height FROM b""")
def word_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", "page_index", "block_seq", "text", *box_columns())


@query(f"""WITH {GLYPHS_SQL},
e AS (SELECT *, abs(y - lag(y) OVER o) >= 1.5 * height AS br FROM b WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY y, x, block_seq)),
p AS (SELECT *, CAST(sum(CASE WHEN br THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index ORDER BY y, x, block_seq) AS INT) AS paragraph FROM e)
SELECT doc_id, CAST(page_index AS INT) AS page_index, paragraph, count(*) AS n_words, string_agg(text, ' ' ORDER BY y, x, block_seq) AS text, round(avg(size), 6) AS avg_font_size, CASE WHEN avg(size) > 18 THEN 1 WHEN avg(size) > 15 THEN 2 ELSE 0 END AS heading_level FROM p GROUP BY 1, 2, 3""")
def paragraph_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.headings(segmentation.paragraphs(_words(spark, sf_dir))).select("doc_id", "page_index", "paragraph", "n_words", "text", r6("avg_font_size").alias("avg_font_size"), "heading_level")


@query(f"""WITH {GLYPHS_SQL},
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y, x, block_seq) AS rn, floor(count(*) OVER (PARTITION BY doc_id, page_index) / 3) AS third
  FROM b WHERE length(text) >= 2 AND height < 0.05 AND width < 0.5)
SELECT doc_id, CAST(page_index AS INT) AS page_index, CAST(block_seq AS INT) AS block_seq, text FROM f WHERE rn > third AND rn <= third + 3""")
def editable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.editable(_words(spark, sf_dir)).select("doc_id", "page_index", "block_seq", "text")


def _line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(table(spark, sf_dir, "documents")).select("doc_id", "page_index", "text")


def _ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page_index"), "text")


LINES_SQL = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents),
nat AS (SELECT doc_id, CAST(l // 63 AS INT) AS page_index, text FROM l),
ocr AS (SELECT item_id AS doc_id, unnest([0, 1]) AS page_index, text FROM benchmark)"""


@query(f"""WITH {LINES_SQL}, full_pages AS (SELECT DISTINCT doc_id, page_index FROM nat WHERE trim(text) <> '')
SELECT nat.* FROM nat SEMI JOIN full_pages USING (doc_id, page_index) UNION ALL SELECT ocr.* FROM ocr ANTI JOIN full_pages USING (doc_id, page_index)""")
def extract_auto_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.auto_extract(_line_blocks(spark, sf_dir), _ocr_blocks(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, added AS (SELECT * FROM ocr WHERE page_index = 0), n AS (SELECT doc_id, count(DISTINCT page_index) AS pages_processed FROM added GROUP BY 1)
SELECT doc_id, count(*) AS n_blocks, any_value(pages_processed) AS pages_processed FROM (SELECT * FROM nat UNION ALL SELECT * FROM added) LEFT JOIN n USING (doc_id) GROUP BY 1""")
def make_searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ocr = _ocr_blocks(spark, sf_dir)
    blocks, done = segmentation.make_searchable(_line_blocks(spark, sf_dir), ocr, ocr.where("page_index = 0"))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks")).join(done, "doc_id", "left")


@query("""WITH w AS (SELECT item_id, text AS t, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark),
b AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM w)
SELECT item_id AS line_id, CAST(pos AS INT) AS pos, word, round(0.1 + n * (0.8 / length(t)), 6) AS x, round(length(word) * (0.8 / length(t)), 6) AS width FROM b WHERE word <> ''""")
def ocr_word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_id"), "text", F.lit(0.1).alias("x"), F.lit(0.8).alias("width"))
    return segmentation.ocr_word_positions(lines).select("line_id", "pos", "word", r6("x").alias("x"), r6("width").alias("width"))


# ---------------------------------------------------------------------------------- pages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pages(table(spark, sf_dir, "documents"))


@query(f"WITH p AS ({PAGES_SQL}) SELECT doc_id, CAST(count(*) AS INT) AS page_count FROM p GROUP BY 1")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.metadata(_pages(spark, sf_dir))


@query(f"""WITH p AS ({PAGES_SQL}), n AS (SELECT doc_id, doc_id // 10 AS out_id, count(*) AS n FROM p GROUP BY 1),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY out_id ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n)
SELECT out_id AS doc_id, CAST(page_index + off AS INT) AS page_index, p.doc_id AS from_doc, CAST(page_index AS INT) AS from_page FROM p JOIN o USING (doc_id)""")
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    inputs = ids.select(F.floor(F.col("doc_id") / 10).alias("out_id"), (-F.col("doc_id")).alias("pos"), "doc_id")
    return page_ops.merge(_pages(spark, sf_dir), inputs).select("doc_id", "page_index", "from_doc", "from_page")


@query(f"""WITH p AS ({PAGES_SQL}), r AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 2147483647)) AS r(part, a, b))
SELECT doc_id, part, CAST(page_index - a AS INT) AS page_index, CAST(page_index AS INT) AS from_page FROM p JOIN r ON page_index BETWEEN a AND b""")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(a).alias("first"), F.lit(b).alias("last")) for i, (a, b) in enumerate(((0, 0), (0, 1), (1, 2147483647)))))
    asked = table(spark, sf_dir, "documents").select("doc_id", F.explode(ranges).alias("r")).select("doc_id", "r.*")
    return page_ops.split(_pages(spark, sf_dir), asked)


@query(f"""WITH p AS ({PAGES_SQL}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS INT) AS page_index, CAST(page_index AS INT) AS from_page FROM p WHERE page_index <> 1""")
def delete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(1), F.lit(-1), F.lit(500))).alias("page_index"))
    return page_ops.delete(_pages(spark, sf_dir), gone).select("doc_id", "page_index", "from_page")


@query(f"""WITH p AS ({PAGES_SQL}), o AS (SELECT * FROM (VALUES (0, 1), (1, 0), (2, 0)) AS o(pos, page_index))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS page_index, CAST(page_index AS INT) AS from_page FROM p JOIN o USING (page_index)""")
def reorder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "documents").select("doc_id", F.array(F.lit(1), F.lit(0), F.lit(0)).alias("order"))
    return page_ops.reorder(_pages(spark, sf_dir), orders).select("doc_id", "page_index", "from_page")


@query(f"""WITH p AS ({PAGES_SQL}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
a AS (SELECT *, CASE WHEN page_index = 0 THEN n - 1 ELSE page_index - 1 END AS q FROM n)
SELECT doc_id, CAST(CASE WHEN n < 2 THEN q WHEN q = 1 THEN 0 WHEN q = 0 THEN 1 ELSE q END AS INT) AS page_index, CAST(page_index AS INT) AS from_page FROM a""")
def move_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each document goes last, then what is second goes first; a third move, of no page, is passed over."""
    p = _pages(spark, sf_dir)
    step = lambda o, s, t: F.struct(F.lit(o).alias("ord"), F.lit(s).alias("source"), t.alias("target"))
    each = F.explode(F.array(step(2, 1, F.lit(0)), step(1, 0, F.col("page_count") - 1), step(3, -1, F.lit(0)))).alias("m")
    return page_ops.move(p, page_ops.metadata(p).select("doc_id", each).select("doc_id", "m.*")).select("doc_id", "page_index", "from_page")


@query(f"""WITH p AS ({PAGES_SQL}) SELECT doc_id, CAST(page_index AS INT) AS page_index, CAST(CASE WHEN page_index = 0 THEN 842 ELSE 595 END AS DOUBLE) AS width,
CAST(CASE WHEN page_index = 0 THEN 595 ELSE 842 END AS DOUBLE) AS height, CASE WHEN page_index = 0 THEN 270 WHEN page_index = 1 THEN 180 ELSE 0 END AS rotation FROM p""")
def rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter to the left for the first page, two quarters to the right for the second."""
    turn = lambda p, d: F.struct(F.lit(p).alias("page_index"), F.lit(d).alias("degrees"))
    turns = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(turn(0, -90), turn(1, 90), turn(1, 90))).alias("t")).select("doc_id", "t.*")
    return page_ops.rotate_pages(_pages(spark, sf_dir), turns)


@query(f"""WITH p AS ({PAGES_SQL}) SELECT doc_id, CAST(CASE WHEN page_index >= 1 THEN page_index + 2 ELSE page_index + 1 END AS INT) AS page_index, CAST(595 AS DOUBLE) AS width FROM p
UNION ALL SELECT doc_id, 2, 300 FROM documents UNION ALL SELECT doc_id, 0, 200 FROM documents""")
def insert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page before the second of each document, then one before the first."""
    page = lambda o, at, w: F.struct(F.lit(o).alias("ord"), F.lit(at).alias("page_index"), F.lit(w).alias("width"), F.lit(400.0).alias("height"))
    new = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(page(2, 0, 200.0), page(1, 1, 300.0))).alias("n")).select("doc_id", "n.*")
    return page_ops.insert(_pages(spark, sf_dir), new).select("doc_id", F.col("page_index").cast("int").alias("page_index"), "width")


@query("""WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, user_id, event_type FROM e WHERE b IS NULL OR b <> event_type""")
def page_change_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.page_changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


# ---------------------------------------------------------------------------------- annotations, boxes


def _raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    subtype = F.when(F.col("l_returnflag") == "A", "Highlight").when(F.col("l_returnflag") == "N", "Text").when(F.col("l_linenumber") == 1, "Link").otherwise("Ink")
    lly = F.col("l_suppkey").cast("double")
    seq = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_index"), F.row_number().over(seq).alias("seq"), subtype.alias("subtype"),
        F.col("l_quantity").alias("llx"), lly.alias("lly"), (F.col("l_quantity") + 20).alias("urx"), (lly + 10).alias("ury"),
        (F.col("l_quantity") / 64).alias("r"), F.lit(0.5).alias("g"), F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") / 8.0).alias("b"), F.col("l_linestatus").alias("contents"), F.lit(595.0).alias("page_w"), F.lit(842.0).alias("page_h"),
    )


ANNOTATIONS_SQL = """a AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_index, l_quantity AS llx, CAST(l_suppkey AS DOUBLE) AS lly, l_linestatus AS text,
  CASE WHEN l_linestatus = 'O' THEN '#' || upper(printf('%02x%02x%02x', CAST(trunc(l_quantity / 64 * 255) AS INT), 127, CAST(trunc(l_linenumber / 8.0 * 255) AS INT))) ELSE '#000000' END AS color,
  CASE WHEN l_returnflag = 'A' THEN 'highlight' WHEN l_returnflag = 'N' THEN 'note' WHEN l_linenumber = 1 THEN 'link' ELSE 'freehand' END AS type FROM lineitem),
n AS (SELECT *, CAST(page_index AS VARCHAR) || '_' || CAST(CAST(round(llx) AS INT) AS VARCHAR) || '_' || CAST(CAST(round(lly) AS INT) AS VARCHAR) || '_' || type AS id FROM a WHERE type <> 'link')"""


@query(f"""WITH {ANNOTATIONS_SQL} SELECT doc_id, id, type, CAST(page_index AS INT) AS page_index, color, round(llx / 595.0, 6) AS x,
round(1 - (lly + 10) / 842.0, 6) AS y, round(20 / 595.0, 6) AS width, round(10 / 842.0, 6) AS height, text FROM n""")
def annotations_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations.list_annotations(_raw_annotations(spark, sf_dir))
    return a.select("doc_id", "id", "type", "page_index", "color", *(r6(c).alias(c) for c in ("x", "y", "width", "height")), "text")


@query(f"""WITH {ANNOTATIONS_SQL}, k AS (SELECT doc_id, id, any_value(type) AS type, count(*) AS c FROM n GROUP BY 1, 2)
SELECT doc_id, id, CASE WHEN type = 'highlight' THEN c - 1 ELSE c END AS n_left FROM k WHERE NOT (type = 'highlight' AND c = 1)""")
def annotation_delete_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations.list_annotations(_raw_annotations(spark, sf_dir))
    left = annotations.delete_first(a, a.where("type = 'highlight'").select("doc_id", "id"))
    return left.groupBy("doc_id", "id").agg(F.count("*").alias("n_left"))


@query("""WITH r AS (SELECT p_partkey AS doc_id, unnest([1e-1, 5e-1]) AS x, p_size / 1e2 AS y FROM part)
SELECT doc_id, 0 AS page_index, 5e-1 AS opacity, round(x * 595.0, 6) AS x, round((1 - y - 5e-2) * 842e0, 6) AS y, round(2e-1 * 595e0, 6) AS w, round(5e-2 * 842e0, 6) AS h FROM r""")
def annotations_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rect = lambda x: F.struct(F.lit(x).alias("x"), (F.col("p_size") / 100.0).alias("y"), F.lit(0.2).alias("width"), F.lit(0.05).alias("height"))
    part = part.withColumn("rects", F.array(rect(0.1), rect(0.5)))
    want = part.select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(7))).alias("page_index"), F.lit("highlight").alias("type"), F.lit("#FFFF00").alias("color"), F.lit(None).cast("double").alias("opacity"), F.lit("").alias("text"), "rects")
    pages = part.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return annotations.add_annotations(pages, want).select("doc_id", "page_index", "opacity", *(r6(c).alias(c) for c in ("x", "y", "w", "h")))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id, i // 2 AS k, max(CASE WHEN i % 2 = 0 THEN CAST(v AS DOUBLE) END) AS x, max(CASE WHEN i % 2 = 1 THEN CAST(v AS DOUBLE) END) AS y FROM e GROUP BY 1, 2)
SELECT vec_id, round(min(x) - 5, 6) AS llx, round(min(y) - 5, 6) AS lly, round(max(x) + 5, 6) AS urx, round(max(y) + 5, 6) AS ury FROM p GROUP BY 1""")
def freehand_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double")
    points = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 2).cast("int") - 1)).alias("k"), "embedding").select("vec_id", at(F.col("k") * 2).alias("x"), at(F.col("k") * 2 + 1).alias("y"))
    return annotations.freehand_box(points, ["vec_id"]).select("vec_id", *(r6(c).alias(c) for c in ("llx", "lly", "urx", "ury")))


@query("""WITH h AS (SELECT event_id, p_partkey, p_size FROM events JOIN part ON user_id % 200 = p_partkey % 200
  AND value >= p_size AND value <= p_size + 40 AND 5 * value >= p_retailprice / 100 AND 5 * value <= p_retailprice / 100 + 600)
SELECT event_id AS point_id, max(p_partkey) AS overlay_id, count(*) AS n_hits FROM h GROUP BY 1""")
def overlay_hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), (F.col("user_id") % 200).alias("page_index"), F.col("value").alias("x"), (5 * F.col("value")).alias("y"))
    key = F.col("p_partkey")
    boxes = table(spark, sf_dir, "part").select(key.alias("overlay_id"), key.alias("ord"), (key % 200).alias("page_index"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), F.lit(40.0).alias("width"), F.lit(600.0).alias("height"))
    return spatial.hit_test(points, boxes)


@query(f"""WITH {LINES_SQL}, hit AS (SELECT item_id AS doc_id, 0 AS page_index FROM benchmark)
SELECT doc_id, count(*) AS n_left FROM nat ANTI JOIN hit USING (doc_id, page_index) GROUP BY 1""")
def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_index"))
    left, _ = spatial.redact(_line_blocks(spark, sf_dir), areas)
    return left.groupBy("doc_id").agg(F.count("*").alias("n_left"))


@query("""SELECT l_orderkey AS doc_id, CAST(l_linenumber - 1 AS INT) AS page_index, count(*) AS n_areas, min(l_quantity) AS first_x FROM lineitem GROUP BY 1, 2""")
def redact_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    r = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_index"), F.col("l_quantity").alias("ord"), F.col("l_quantity").alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"))
    return spatial.redaction_areas(r).select("doc_id", "page_index", F.size("areas").cast("bigint").alias("n_areas"), F.col("areas")[0]["x"].alias("first_x"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents),
b AS (SELECT doc_id, CAST(l // 63 AS INT) AS page_index, 40e0 AS x, 842e0 - (50e0 + 12 * (l % 63)) AS y, text FROM l),
e AS (SELECT item_id AS doc_id, 0 AS page_index, 30e0 AS x, 600e0 AS y, 200e0 AS width, 100e0 AS height, text FROM benchmark),
k AS (SELECT doc_id, page_index, x, y, text FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = b.doc_id AND e.page_index = b.page_index
  AND b.x >= e.x - 15 AND b.x <= e.x + e.width + 15 AND b.y >= e.y - 15 AND b.y <= e.y + e.height + 15))
SELECT doc_id, page_index, round(x, 6) AS x, round(y, 6) AS y, text, CAST(NULL AS DOUBLE) AS font_size FROM k UNION ALL
SELECT doc_id, page_index, round(x + 1, 6), round(y + height * 0.15, 6), text, round(85.0 - 0.5 * least(greatest(0, ceil((85.0 - 198.0 / (length(text) * 0.6)) / 0.5)), ceil(81 / 0.5)), 6) FROM e""")
def edit_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layout.lines(table(spark, sf_dir, "documents")).select("doc_id", "page_index", F.lit(40.0).alias("x"), (842.0 - (50.0 + 12 * F.col("line"))).alias("y"), (6.0 * F.length("text")).alias("width"), F.lit(10.0).alias("height"), "text")
    e = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(30.0).alias("x"), F.lit(600.0).alias("y"), F.lit(200.0).alias("width"), F.lit(100.0).alias("height"), "text", F.lit(None).cast("double").alias("font_size"))
    return spatial.edit_content(b, e, layout.PAGE_W, layout.PAGE_H).select("doc_id", "page_index", r6("x").alias("x"), r6("y").alias("y"), "text", r6("font_size").alias("font_size"))


@query()
def token_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of text-show tokens of a stream made from line items: a page per order."""
    li = table(spark, sf_dir, "lineitem")
    seq = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = li.select("l_orderkey", F.row_number().over(seq).cast("bigint").alias("n"), "l_quantity", "l_suppkey", "l_linestatus")
    op = lambda i, name, *v: F.struct(F.lit(i).alias("i"), F.lit(name).alias("op"), F.array(*v).cast("array<double>").alias("operands"))
    ops = F.array(op(0, "q"), op(1, "cm", F.lit(1), F.lit(0), F.lit(0), F.lit(2), F.col("l_quantity"), F.lit(5)), op(2, "BT"), op(3, "Td", F.lit(3), F.col("l_suppkey")), op(4, "Tj"), op(5, "T*"), op(6, "Tj"), op(7, "Q"))
    tokens = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.explode(ops).alias("o"), "n", "l_linestatus")
    tokens = tokens.select("doc_id", "page_index", (F.col("n") * 10 + F.col("o.i")).alias("seq"), "o.op", "o.operands", F.col("l_linestatus").alias("text"))
    return token_ops.locate_text(tokens)


ORACLES["token_origins"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)
SELECT l_orderkey AS doc_id, 0 AS page_index, n * 10 + unnest([4, 6]) AS seq, 'Tj' AS op, l_linestatus AS text, 3.0 + l_quantity AS x, 2e0 * l_suppkey + 5 AS y FROM r"""


# ---------------------------------------------------------------------------------- forms, outline


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    da = F.when(F.col("c_nationkey") % 3 == 0, "0 g").otherwise(F.concat(F.lit("/Helv "), (F.col("c_nationkey") + 8).cast("string"), F.lit(" Tf 0 g")))
    field = lambda name, kind, value: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("class"), value.alias("value"))
    each = F.explode(F.array(field("status", "Tx", F.col("c_mktsegment")), field("urgent", "Btn", F.lit("Off")), field("name", "Tx", F.col("c_name"))))
    return forms.form_fields(c.select(F.col("c_custkey").alias("doc_id"), da.alias("da"), F.array().cast("array<string>").alias("options"), each.alias("f")).select("doc_id", "da", "options", "f.*"))


@query("""SELECT c_custkey AS doc_id, f.name AS id, f.type AS type, f.value AS value, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey + 8 AS DOUBLE) END AS font_size,
CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'Helv' END AS font_name FROM (SELECT *, unnest([{'name': 'status', 'type': 'text', 'value': c_mktsegment}, {'name': 'urgent', 'type': 'checkbox', 'value': 'Off'}, {'name': 'name', 'type': 'text', 'value': c_name}]) AS f FROM customer)""")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("doc_id", "id", "type", "value", "font_size", "font_name")


@query("""WITH v AS (SELECT o_custkey, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS s, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS p FROM orders GROUP BY 1)
SELECT c_custkey AS doc_id, f.name AS id, f.value AS value, f.filled AS filled FROM (SELECT c_custkey, unnest([{'name': 'status', 'value': coalesce(s, c_mktsegment), 'filled': s IS NOT NULL},
{'name': 'urgent', 'value': CASE WHEN p = '1-URGENT' THEN 'Yes' ELSE 'Off' END, 'filled': s IS NOT NULL}, {'name': 'name', 'value': c_name, 'filled': FALSE}]) AS f FROM customer LEFT JOIN v ON c_custkey = o_custkey)""")
def form_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pair = lambda name, value: F.struct(F.lit(name).alias("id"), value.alias("value"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "true").otherwise("false")
    each = F.explode(F.array(pair("status", F.col("o_orderstatus")), pair("urgent", urgent), pair("no such field", F.lit("x"))))
    values = o.select(F.col("o_custkey").alias("doc_id"), F.struct("o_orderdate", "o_orderkey").alias("ord"), each.alias("v")).select("doc_id", "ord", "v.*")
    return forms.fill(_fields(spark, sf_dir), values).select("doc_id", "id", "value", "filled")


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = lambda c: F.col(c).cast("bigint")
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    home = n.select("n_nationkey", "n_regionkey")
    return (
        r.select(big("r_regionkey").alias("doc_id"), big("r_regionkey").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), big("r_regionkey").alias("ord"), F.col("r_name").alias("title"))
        .unionAll(n.select(big("n_regionkey"), big("n_nationkey") + 1000, big("n_regionkey"), big("n_nationkey"), "n_name"))
        .unionAll(c.join(home, c["c_nationkey"] == home["n_nationkey"]).select(big("n_regionkey"), big("c_custkey") + 1_000_000, big("c_nationkey") + 1000, big("c_custkey"), "c_name"))
    )


OUTLINE_SQL = """t AS (
SELECT r_regionkey AS doc_id, CAST(r_regionkey AS BIGINT) AS node_id, r_name AS title, 0 AS level, -1 AS a, CAST(-1 AS BIGINT) AS b, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS children FROM region
UNION ALL SELECT n_regionkey, n_nationkey + 1000, n_name, 1, n_nationkey, -1, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation
UNION ALL SELECT n_regionkey, c_custkey + 1000000, c_name, 2, n_nationkey, c_custkey, 0 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH {OUTLINE_SQL} SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS INT) AS seq, node_id, title, level, CAST(children AS INT) AS children FROM t""")
def bookmark_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bookmarks.flatten(_outline(spark, sf_dir)).select("doc_id", "seq", "node_id", "title", "level", "children")


@query(f"""WITH {OUTLINE_SQL}, k AS (SELECT * FROM t WHERE a <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = t.doc_id))
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS INT) AS seq, node_id, level FROM k""")
def bookmark_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = bookmarks.flatten(_outline(spark, sf_dir))
    return bookmarks.remove(flat, flat.where("seq = 1").select("doc_id", "seq")).select("doc_id", "seq", "node_id", "level")


@query(f"""WITH RECURSIVE {OUTLINE_SQL}, f AS (SELECT doc_id, level, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS seq FROM t), n AS (SELECT doc_id, count(*) AS have FROM f GROUP BY 1),
i AS (SELECT n_regionkey AS doc_id, s_suppkey, s_name AS title, s_suppkey * 37 % 500 - 1 AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 9 BETWEEN 1 AND 7),
x AS (SELECT i.*, have + row_number() OVER (PARTITION BY doc_id ORDER BY s_suppkey) - 1 AS idx, have FROM i JOIN n USING (doc_id)),
y AS (SELECT *, CASE WHEN p >= 0 AND p < idx THEN p ELSE -1 END AS parent FROM x),
r AS (SELECT y.doc_id, idx, title, parent, CASE WHEN parent < 0 THEN 0 ELSE level + 1 END AS level FROM y LEFT JOIN f ON y.doc_id = f.doc_id AND parent = f.seq WHERE parent < have
  UNION ALL SELECT y.doc_id, y.idx, y.title, y.parent, r.level + 1 FROM y JOIN r ON y.doc_id = r.doc_id AND y.parent = r.idx WHERE y.parent >= y.have)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(idx AS INT) AS index, title, CAST(parent AS INT) AS parent, CAST(level AS INT) AS level FROM r""")
def bookmark_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as new bookmarks below regions, nations, customers and other new ones; those on pages outside 0 to 6 are passed over."""
    flat = bookmarks.flatten(_outline(spark, sf_dir))
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    items = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").cast("bigint").alias("doc_id"), key.alias("ord"), F.col("s_name").alias("title"), (key % 9 - 1).cast("int").alias("page_index"), F.lit(7).alias("page_count"), (key * 37 % 500 - 1).cast("int").alias("parent_index"))
    return bookmarks.add(flat, items)


# ---------------------------------------------------------------------------------- templates


@query("""SELECT o_orderkey, 'Invoice ' || CAST(o_orderkey AS VARCHAR) || ' for ' || c_name || ' (' || c_mktsegment || '): {{}} ' || '' || '.' AS text FROM orders JOIN customer ON o_custkey = c_custkey""")
def template_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    data = F.to_json(F.struct(F.col("o_orderkey").alias("number"), F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment")).alias("more")).alias("client")))
    text = F.lit("Invoice {{number}} for {{client.name}} ({{client.more.segment}}): {{}} {{client.none}}.")
    known = ("number", "client.name", "client.more.segment", "client.none")

    def resolve(key: Column) -> Column:
        out = F.lit("")
        for path in known:
            out = F.when(key == path, key_path(F.col("data"), path)).otherwise(out)
        return out

    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", data.alias("data")).select("o_orderkey", bind(text, resolve).alias("text"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS VARCHAR), '') AS k, coalesce(json_extract_string(props, '$.none.at'), '') AS missing FROM events")
def json_key_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", key_path(F.col("props"), "k").alias("k"), key_path(F.col("props"), "none.at").alias("missing"))


INVOICE_SQL = "r AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem)"


@query(f"""WITH {INVOICE_SQL}, p AS (SELECT *, i - 3 AS late FROM r)
SELECT l_orderkey, CAST(i AS INT) AS i, CAST(CASE WHEN i < 3 THEN 0 ELSE late // 5 + 1 END AS INT) AS page, CAST(CASE WHEN i < 3 THEN i ELSE late % 5 END AS INT) AS place, i % 2 = 1 AS striped FROM p""")
def table_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = li.select("l_orderkey", (F.row_number().over(order) - 1).alias("i"))
    return templates.table_pages(rows, ["l_orderkey"], "i", head=30.0, row=24.0, room=165.0, first_room=110.0)


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda t: 14.4 * greatest(1, ceil(length(t) * 6 / 515.0))) AS h FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(list_transform(h, lambda x: {'p': 0, 'c': x, 'h': x}), lambda a, x: CASE WHEN a.c + x.h > 762 THEN {'p': a.p + 1, 'c': x.h, 'h': x.h} ELSE {'p': a.p, 'c': a.c + x.h, 'h': x.h} END,
  {'p': 0, 'c': CAST(0 AS DOUBLE), 'h': CAST(0 AS DOUBLE)}) AS e FROM l)
SELECT doc_id, CAST(e.p + 1 AS INT) AS n_pages, round(e.c, 6) AS bottom FROM f""")
def flow_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = 14.4 * F.greatest(F.lit(1.0), F.ceil(F.length("text") * 6 / 515.0))
    items = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).select("doc_id", "ord", height.alias("h"))
    placed = templates.paginate(items, ["doc_id"], ["ord"], "h", 762.0)
    last = F.max_by(F.struct("page", "top", "h"), "ord").alias("x")
    return placed.groupBy("doc_id").agg(last).select("doc_id", (F.col("x.page") + 1).alias("n_pages"), r6(F.col("x.top") + F.col("x.h")).alias("bottom"))


@query("""WITH p AS (SELECT item_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM benchmark),
w AS (SELECT item_id, n, list_reduce(string_split(t, ' '), lambda a, x: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(x) <= 40 THEN a || ' ' || x ELSE a || chr(10) || x END) AS t FROM p)
SELECT item_id, string_agg(t, chr(10) ORDER BY n) AS wrapped FROM w GROUP BY 1""")
def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(templates.wrap(F.col("text"), 40), "\n").alias("wrapped"))


@query("""WITH s AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
e AS (SELECT conv_id, 2 * i AS pos, CAST(i AS VARCHAR) || '. ' || role AS element FROM s UNION ALL SELECT conv_id, 2 * i + 1, text FROM s
UNION ALL SELECT DISTINCT conv_id, 0, 'title' FROM s UNION ALL SELECT conv_id, 2 * max(i) + 2, 'end' FROM s GROUP BY 1)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS INT) AS pos, element FROM e""")
def section_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("heading"), t["text"].alias("content"))).alias("sections"))
    body = F.array(F.lit("title"), F.lit("sections"), F.lit("end"))
    return c.select("conv_id", F.posexplode(templates.expand_sections(body, F.col("sections"))).alias("pos", "element"))


@query("""WITH w AS (SELECT p_brand, p_partkey, p_size, (5000 - 10.0 * (count(*) OVER (PARTITION BY p_brand) - 1)) * p_size / sum(p_size) OVER (PARTITION BY p_brand) AS w FROM part)
SELECT p_partkey, round(w, 4) AS col_width, round(coalesce(sum(w + 10.0) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS col_x FROM w""")
def proportional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = templates.column_boxes(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "p_size", 5000.0)
    return c.select("p_partkey", F.round("col_width", 4).alias("col_width"), F.round("col_x", 4).alias("col_x"))


# ---------------------------------------------------------------------------------- documents out and in, colours, streams


def _runs(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    lines = table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("para_seq", "text"))
    return lines.select("doc_id", "para_seq", F.lit(0).alias("run_seq"), "text", F.when(F.col("para_seq") == 0, 20.0).otherwise(11.0).alias("font_size"), F.when(F.col("para_seq") == 0, "Arial-BoldItalic").otherwise("Arial").alias("font_name"))


XML_SQL = """replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')"""


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
x AS (SELECT doc_id, i, '<w:p>' || CASE WHEN i = 0 THEN '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' ELSE '' END || '<w:r><w:rPr>' || CASE WHEN i = 0 THEN '<w:b/><w:i/>' ELSE '' END
  || '<w:sz w:val="' || CASE WHEN i = 0 THEN '40' ELSE '22' END || '"/></w:rPr><w:t xml:space="preserve">' || {XML_SQL} || '</w:t></w:r></w:p>' AS x FROM l)
SELECT doc_id, md5(string_agg(x, '' ORDER BY i)) AS body_md5, CAST(sum(length(x)) AS BIGINT) AS body_chars FROM x GROUP BY 1""")
def docx_runs_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = docx_xml.body_xml(_runs(spark, sf_dir, "documents", "doc_id"))
    return body.select("doc_id", F.md5(F.encode("body", "UTF-8")).alias("body_md5"), F.length("body").cast("bigint").alias("body_chars"))


@query("""SELECT item_id AS doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS para_seq, unnest(string_split(text, chr(10))) AS text,
CAST(generate_subscripts(string_split(text, chr(10)), 1) = 1 AS BOOLEAN) AS bold FROM benchmark""")
def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = docx.pack_docx(docx_xml.body_xml(_runs(spark, sf_dir, "benchmark", "item_id")))
    runs = docx.parse_files(files.select(F.col("doc_id").cast("string").alias("path"), "content"))
    return runs.select(F.col("path").cast("bigint").alias("doc_id"), "para_seq", "text", "bold")


@query("""WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '#GG0000' WHEN p_partkey % 7 = 0 THEN '#FFF' ELSE CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE '' END || upper(printf('%06x', (p_partkey * 7919) % 16777216)) END AS t FROM part),
v AS (SELECT *, regexp_matches(t, '^#?[0-9A-Fa-f]{6}$') AS ok, ltrim(t, '#') AS d FROM h)
SELECT p_partkey, CASE WHEN ok THEN CAST('0x' || d[1:2] AS INT) ELSE 255 END AS r, CASE WHEN ok THEN CAST('0x' || d[3:4] AS INT) ELSE 255 END AS g, CASE WHEN ok THEN CAST('0x' || d[5:6] AS INT) ELSE 0 END AS b FROM v""")
def color_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    digits = F.lpad(F.hex((k * 7919) % 16777216), 6, "0")
    text = F.when(k % 5 == 0, "#GG0000").when(k % 7 == 0, "#FFF").otherwise(F.concat(F.when(k % 2 == 0, "#").otherwise(""), digits))
    return table(spark, sf_dir, "part").select("p_partkey", parse_hex(text, (255, 255, 0)).alias("c")).select("p_partkey", "c.*")


@query("""SELECT p_partkey, '#' || upper(printf('%02x%02x%02x', CAST(trunc(p_size / 50.0 * 255) AS INT), CAST(trunc(0.5 * 255) AS INT), CAST(trunc((p_partkey % 100) / 100.0 * 255) AS INT))) AS color FROM part""")
def color_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", format_hex(F.col("p_size") / 50.0, F.lit(0.5), (F.col("p_partkey") % 100) / 100.0).alias("color"))


@query("""SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_events.replay(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/events.parque[t]")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


def _more() -> None:
    """The queries of the other modules, which register themselves here."""
    from quillspark.plans import generation

    generation.queries_loaded()


def queries() -> dict[str, Query]:
    _more()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(ORACLES)
