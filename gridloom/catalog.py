"""Registered queries: the engine's operators over the Parquet tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells
from .operators import columns as cols
from .operators import edits, filters, replacing, search, sorting
from .operators.filters import Contains, Equals
from .plans.ordinals import with_ordinal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Columns of the tables as the sheets below have them, and keys that tell their rows apart.
SHEETS = {
    "region": (["r_regionkey"], ["r_regionkey", "r_name"]),
    "nation": (["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"]),
    "customer": (["c_custkey"], ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    "supplier": (["s_suppkey"], ["s_suppkey", "s_name", "s_nationkey"]),
    "part": (["p_partkey"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]),
    "orders": (["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    "events": (["event_id"], ["event_id", "user_id", "event_type"]),
    "documents": (["doc_id"], ["doc_id", "text", "lang", "source"]),
    "pages": (["page_id"], ["page_id", "url"]),
    "conversations": (["conv_id", "turn"], ["conv_id", "turn", "role", "text"]),
}


def sheet(spark: SparkSession, sf_dir: str, table: str, row: bool = False, cell: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """A table as rows of ``fields`` with its keys, and ``row`` where an operator needs places."""
    keys, names = SHEETS[table]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    fields = F.array(*(F.col(n).cast("string") for n in names)) if cell is None else cell
    df = df.select(*keys, *(k for k in keep if k not in keys), fields.alias("fields"))
    return with_ordinal(df, keys) if row else df


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def named(fields: Column, *names: str) -> list[Column]:
    return [cells.cell(fields, i).alias(n) for i, n in enumerate(names)]


URL_PIECES = "string_split(url, '/')"


def url_pieces() -> Column:
    return F.split("url", cells.literal_pattern("/"), -1)


# Sources ------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 100")
def head_rows(spark, d):
    first = sheet(spark, d, "orders", keep=["o_orderpriority"]).drop("fields").orderBy("o_orderkey").limit(100)
    return with_ordinal(first, ["o_orderkey"])


@query("SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey, o_custkey FROM orders) WHERE row BETWEEN 500 AND 549")
def row_range(spark, d):
    window = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(500).limit(50)
    return with_ordinal(window, ["o_orderkey"]).withColumn("row", F.col("row") + 500)


# Filters ------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def filter_contains(spark, d):
    return filters.matching(sheet(spark, d, "part", keep=["p_name"]), [Contains(1, "ring")]).drop("fields")


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE contains(text, chr(10))")
def filter_contains_multiline(spark, d):
    return filters.matching(sheet(spark, d, "documents", keep=["text"]), [Contains(1, "\n")]).select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_equals(spark, d):
    return filters.matching(sheet(spark, d, "orders", keep=["o_orderpriority"]), [Equals(3, "1-URGENT")]).drop("fields")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(p_name, 'r') AND contains(p_type, 'ECONOMY') AND p_size::VARCHAR = '7'")
def filter_and(spark, d):
    return filters.matching(sheet(spark, d, "part", keep=["p_name", "p_type"]), [Contains(1, "r"), Contains(3, "ECONOMY"), Equals(4, "7")]).drop("fields")


@query(f"SELECT page_id, len({URL_PIECES}) AS pieces FROM pages WHERE {URL_PIECES}[6] = ''")
def filter_missing_vs_empty(spark, d):
    rows = sheet(spark, d, "pages", cell=url_pieces())
    return filters.matching(rows, [Equals(5, "")]).select("page_id", F.size("fields").cast("bigint").alias("pieces"))


@query(f"SELECT count(*) FILTER ({URL_PIECES}[6] = '') AS empty, count(*) FILTER (len({URL_PIECES}) < 6) AS missing, count(*) AS n FROM pages")
def missing_cells(spark, d):
    rows = sheet(spark, d, "pages", cell=url_pieces())
    sixth = cells.cell(F.col("fields"), 5)
    return rows.agg(F.count_if(sixth == "").alias("empty"), F.count_if(sixth.isNull()).alias("missing"), F.count("*").alias("n"))


_EVENTS = "SELECT *, row_number() OVER (ORDER BY row) - 1 AS match FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS row FROM events) WHERE event_type = 'error'"


def error_events(spark, d):
    return filters.matching(sheet(spark, d, "events", row=True, keep=["event_type"]), [Equals(2, "error")]).drop("fields")


@query(_EVENTS)
def filter_match_ordinals(spark, d):
    return filters.match_ordinals(error_events(spark, d))


@query(f"SELECT * FROM ({_EVENTS}) WHERE match BETWEEN 100 AND 149")
def filtered_range(spark, d):
    return filters.match_range(error_events(spark, d), 100, 50)


@query("SELECT count(*) FILTER (contains(text, 'The')) AS upper, count(*) FILTER (contains(text, 'the')) AS lower FROM documents")
def filter_case_sensitive(spark, d):
    f = F.col("fields")
    return sheet(spark, d, "documents").agg(F.count_if(cells.contains(f, 1, "The")).alias("upper"), F.count_if(cells.contains(f, 1, "the")).alias("lower"))


@query("SELECT count(*) AS matches FROM orders WHERE contains(o_orderpriority, 'H') AND o_orderstatus = 'F'")
def match_count(spark, d):
    return filters.matching(sheet(spark, d, "orders"), [Contains(3, "H"), Equals(2, "F")]).agg(F.count("*").alias("matches"))


# Search -------------------------------------------------------------------

_CELLS = """
  SELECT row, "column", text FROM (
    SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, unnest([0, 1, 2, 3]) AS "column", unnest([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment]) AS text FROM customer)
"""


@query(f'SELECT row, "column" FROM ({_CELLS}) WHERE contains(text, \'MACH\') ORDER BY 1, 2 LIMIT 1')
def search_first(spark, d):
    return search.find_next(sheet(spark, d, "customer", row=True).select("row", "fields"), "MACH")


@query(f'SELECT row, "column" FROM ({_CELLS}) WHERE contains(text, \'11\') AND (row, "column") >= (111, 1) ORDER BY 1, 2 LIMIT 1')
def search_resume(spark, d):
    return search.find_next(sheet(spark, d, "customer", row=True).select("row", "fields"), "11", (111, 1))


_EDITS = {(3, 1): "kept away", (7, 3): "a needle here", (1, 9): "a needle nowhere", (12, 1): "needle"}


@query(f"""SELECT row, "column" FROM (SELECT row, "column", CASE WHEN (row, "column") = (7, 3) THEN 'a needle here' WHEN (row, "column") = (3, 1) THEN 'kept away'
  WHEN (row, "column") = (12, 1) THEN 'needle' ELSE text END AS text FROM ({_CELLS})) WHERE contains(text, 'needle') ORDER BY 1, 2""")
def search_overlay(spark, d):
    rows = edits.apply_edits(sheet(spark, d, "customer", row=True).select("row", "fields"), _EDITS)
    return search.hits(rows, "needle")


# Replace ------------------------------------------------------------------


@query("SELECT doc_id, replace(text, 'the', 'THE') AS text, CAST((strlen(text) - strlen(replace(text, 'the', ''))) / 3 AS BIGINT) AS replacements FROM documents WHERE contains(text, 'the')")
def replace_all(spark, d):
    rows = filters.matching(sheet(spark, d, "documents"), [Contains(1, "the")]).withColumn("fields", F.slice("fields", 2, 1))
    return replacing.replaced(rows, "the", "THE").select("doc_id", cells.cell(F.col("fields"), 0).alias("text"), "replacements")


@query("SELECT CAST(sum((strlen(text) - strlen(replace(text, 'on', ''))) // 2) AS BIGINT) AS replacements FROM documents")
def replace_total(spark, d):
    return replacing.replacement_total(sheet(spark, d, "documents").withColumn("fields", F.slice("fields", 2, 1)), "on")


@query("SELECT doc_id, (strlen(t) - strlen(replace(t, 'anan', ''))) // 4 AS replacements, strlen(replace(t, 'anan', 'X')) AS bytes FROM (SELECT doc_id, replace(text, 'on', 'anan') AS t FROM documents) WHERE contains(t, 'ananan')")
def replace_overlapping(spark, d):
    rows = sheet(spark, d, "documents", cell=F.array(F.replace("text", F.lit("on"), F.lit("anan"))))
    out = replacing.replaced(filters.matching(rows, [Contains(0, "ananan")]), "anan", "X")
    return out.select("doc_id", "replacements", F.octet_length(cells.cell(F.col("fields"), 0)).cast("bigint").alias("bytes"))


# Columns ------------------------------------------------------------------


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS rest, p_brand FROM part")
def split_fixed(spark, d):
    rows = cols.change(sheet(spark, d, "part"), cols.Split(1, " ", 2))
    f = F.col("fields")
    return rows.select("p_partkey", cells.cell(f, 1).alias("first"), cells.cell(f, 2).alias("rest"), cells.cell(f, 3).alias("p_brand"))


@query(f"SELECT page_id, {URL_PIECES}[1] AS a, coalesce({URL_PIECES}[2], '') AS b, coalesce({URL_PIECES}[3], '') AS c, array_to_string({URL_PIECES}[4:], '/') AS tail FROM pages")
def split_remainder(spark, d):
    rows = cols.change(sheet(spark, d, "pages"), cols.Split(1, "/", 4))
    f = F.col("fields")
    return rows.select("page_id", *(cells.cell(f, i + 1).alias(n) for i, n in enumerate(("a", "b", "c", "tail"))))


@query("SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS a, coalesce(string_split(o_orderpriority, '-')[2], '') AS b, coalesce(string_split(o_orderpriority, '-')[3], '') AS c, coalesce(array_to_string(string_split(o_orderpriority, '-')[4:], '-'), '') AS e FROM orders")
def split_pad(spark, d):
    rows = cols.change(sheet(spark, d, "orders"), cols.Split(3, "-", 4))
    f = F.col("fields")
    return rows.select("o_orderkey", *(cells.cell(f, i + 3).alias(n) for i, n in enumerate(("a", "b", "c", "e"))))


@query(f"SELECT count(*) AS rows_scanned, max(len({URL_PIECES})) AS max_pieces FROM pages")
def split_width(spark, d):
    return cols.split_width(sheet(spark, d, "pages"), 1, "/")


@query("SELECT n_nationkey, n_name || '|' || n_regionkey AS joined FROM nation")
def join_columns(spark, d):
    rows = cols.change(sheet(spark, d, "nation"), cols.Join((1, 2), "|"))
    return rows.select("n_nationkey", cells.cell(F.col("fields"), 1).alias("joined"))


@query("SELECT c_custkey, c_custkey::VARCHAR AS a, c_mktsegment || ', ' || c_name AS joined, c_nationkey::VARCHAR AS b, 3 AS width FROM customer")
def join_caller_order(spark, d):
    rows = cols.change(sheet(spark, d, "customer"), cols.Join((3, 1), ", "))
    return rows.select("c_custkey", *named(F.col("fields"), "a", "joined", "b"), F.size("fields").alias("width"))


@query("SELECT p_partkey, p_brand || p_type AS joined FROM part")
def join_empty_separator(spark, d):
    rows = cols.change(sheet(spark, d, "part"), cols.Join((2, 3), ""))
    return rows.select("p_partkey", cells.cell(F.col("fields"), 2).alias("joined"))


@query("SELECT s_nationkey::VARCHAR AS a, s_suppkey::VARCHAR AS b, s_name AS c FROM supplier")
def arrange_move(spark, d):
    return cols.change(sheet(spark, d, "supplier"), cols.moved(3, [2], 0)).select(*named(F.col("fields"), "a", "b", "c"))


@query("SELECT s_suppkey::VARCHAR AS a, s_nationkey::VARCHAR AS b, 2 AS width FROM supplier")
def arrange_delete(spark, d):
    return cols.change(sheet(spark, d, "supplier"), cols.deleted(3, [1])).select(*named(F.col("fields"), "a", "b"), F.size("fields").alias("width"))


@query(f"SELECT page_id, array_to_string(list_concat([coalesce({URL_PIECES}[3], ''), {URL_PIECES}[1]], {URL_PIECES}[5:]), '|') AS cells FROM pages")
def arrange_ragged(spark, d):
    rows = cols.change(sheet(spark, d, "pages", cell=url_pieces()), cols.Arrange(4, (2, 0)))
    return rows.select("page_id", F.array_join("fields", "|").alias("cells"))


@query("SELECT r_regionkey AS region_id, r_name AS r_name FROM region")
def header_rename(spark, d):
    from .sheet import Sheet

    region = Sheet.from_dataframe(spark.read.parquet(f"{d}/region.parquet"), ["r_regionkey"]).rename({0: "region_id"})
    return region.wide().select(F.col("region_id").cast("int").alias("region_id"), "r_name")


# Edits --------------------------------------------------------------------

_NATION = {(2, 1): "ATLANTIS", (5, 1): "", (9, 2): "4"}


@query("SELECT n_nationkey, CASE n_nationkey WHEN 2 THEN 'ATLANTIS' WHEN 5 THEN '' ELSE n_name END AS n_name, CASE n_nationkey WHEN 9 THEN '4' ELSE n_regionkey::VARCHAR END AS n_regionkey FROM nation")
def edit_overlay(spark, d):
    rows = edits.apply_edits(sheet(spark, d, "nation", row=True), _NATION)
    return rows.select("n_nationkey", *named(F.col("fields"), "_", "n_name", "n_regionkey")).drop("_")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even ' || n_nationkey ELSE n_name END AS n_name FROM nation")
def edit_table(spark, d):
    wanted = spark.range(0, 100, 2).select(F.col("id").alias("row"), F.lit(1).alias("column"), F.concat(F.lit("even "), "id").alias("value"))
    rows = edits.apply_edits(sheet(spark, d, "nation", row=True), wanted)
    return rows.select("n_nationkey", cells.cell(F.col("fields"), 1).alias("n_name"))


@query("SELECT * FROM (VALUES (30, 0, 'x'), (3, 3, 'y'), (24, 7, '')) t(\"row\", \"column\", value)")
def edit_invalid_targets(spark, d):
    return edits.invalid_edits(sheet(spark, d, "nation", row=True), {(30, 0): "x", (3, 3): "y", (24, 7): "", (0, 0): "fine", (24, 2): "fine"})


# Sort ---------------------------------------------------------------------


def _sorted_parts(spark, d, descending):
    return sorting.sort_ordinals(sheet(spark, d, "part", row=True), 1, descending).select("place", "row", "key")


_PARTS = "SELECT row_number() OVER (ORDER BY p_name {0}, row) - 1 AS place, row, p_name AS key FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS row FROM part)"


@query(_PARTS.format(""))
def sort_text_asc(spark, d):
    return _sorted_parts(spark, d, False)


@query(_PARTS.format("DESC"))
def sort_text_desc(spark, d):
    return _sorted_parts(spark, d, True)


@query(f"SELECT row_number() OVER (ORDER BY key, row) - 1 AS place, row, key FROM (SELECT coalesce({URL_PIECES}[6], '') AS key, row_number() OVER (ORDER BY page_id) - 1 AS row FROM pages)")
def sort_missing_as_empty(spark, d):
    return sorting.sort_ordinals(sheet(spark, d, "pages", row=True, cell=url_pieces()), 5).select("place", "row", "key")


@query("SELECT row_number() OVER (ORDER BY key DESC, row) - 1 AS place, row, md5(key) AS digest FROM (SELECT coalesce(text, '') AS key, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents)")
def sort_whole_text(spark, d):
    rows = sheet(spark, d, "documents", row=True, cell=F.array("text"))
    return sorting.sort_ordinals(rows, 0, True).select("place", "row", F.md5(F.col("key").cast("binary")).alias("digest"))


@query("SELECT count(*) - 1 AS adjacencies, 0 AS violations FROM orders")
def sort_tie_check(spark, d):
    return sorting.order_violations(sorting.sort_ordinals(sheet(spark, d, "orders", row=True), 3)).select("adjacencies", F.col("violations").cast("int").alias("violations"))


@query("SELECT count(*) AS n, true AS preserved, true AS placed FROM part")
def multiset_preserved(spark, d):
    """The fingerprint of a table's rows against that of the sorted ones as they were written, whose places must be 0, 1, ..."""
    import uuid

    from .shared import shared_dir

    rows = sheet(spark, d, "part", row=True).withColumn("line", cells.record(F.col("fields"), ","))
    path = f"{shared_dir(spark)}/sorted-{uuid.uuid4().hex}"
    sorting.sort_ordinals(rows, 1).select("place", "line").write.parquet(path)
    written = spark.read.schema("place bigint, line string").parquet(path)
    placed = (F.min("place") == 0) & (F.max("place") == F.count("*") - 1) & (F.count_distinct("place") == F.count("*"))
    before = sorting.fingerprint(rows, "line", F.lit(True).alias("placed"))
    after = sorting.fingerprint(written, "line", placed.alias("placed"))
    return before.union(after).agg(F.max("n").alias("n"), (F.count_distinct("n", "mixed", "total") == 1).alias("preserved"), F.bool_and("placed").alias("placed"))


@query("SELECT CAST(4 * sum(strlen(text)) + 48 * count(*) AS BIGINT) AS bytes FROM documents")
def sort_temp_estimate(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").agg((4 * F.sum(F.octet_length("text")) + 48 * F.count("*")).alias("bytes"))


# Output -------------------------------------------------------------------


def _quote(c: str, sep: str) -> str:
    return f"CASE WHEN contains({c}, '{sep}') OR contains({c}, '\"') OR contains({c}, chr(10)) OR contains({c}, chr(13)) THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query(f"SELECT doc_id, doc_id || ',' || {_quote('text', ',')} || ',' || lang || ',' || source AS line FROM documents")
def serialize_csv(spark, d):
    return sheet(spark, d, "documents").select("doc_id", cells.record(F.col("fields"), ",").alias("line"))


@query(f"SELECT conv_id, turn, conv_id || chr(9) || turn || chr(9) || role || chr(9) || {_quote('text', chr(9))} AS line FROM conversations")
def copy_row_tsv(spark, d):
    return sheet(spark, d, "conversations").select("conv_id", "turn", cells.tsv(F.col("fields")).alias("line"))


@query(f"SELECT count(*) AS rows_written, CAST(sum(strlen(doc_id || ',' || {_quote('text', ',')} || ',' || lang || ',' || source) + 1) AS BIGINT) AS bytes_written FROM documents WHERE lang = 'de'")
def export_bytes(spark, d):
    kept = filters.matching(sheet(spark, d, "documents"), [Equals(2, "de")])
    line = cells.record(F.col("fields"), ",", ending=F.lit("\n"))
    return kept.agg(F.count("*").alias("rows_written"), F.sum(F.octet_length(line)).alias("bytes_written"))


@query("""SELECT "column", kind, count(*) AS n FROM (SELECT "column", CASE WHEN text = '' THEN 'empty' WHEN regexp_full_match(text, '[0-9+\\-.eE]+') AND regexp_matches(text, '[0-9]') THEN 'number' ELSE 'text' END AS kind
  FROM (SELECT unnest([0, 1, 2, 3]) AS "column", unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority]) AS text FROM orders)) GROUP BY ALL""")
def cell_kind_profile(spark, d):
    cell = sheet(spark, d, "orders").select(F.posexplode("fields").alias("column", "text"))
    return cell.groupBy("column", cells.cell_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z_][A-Za-z0-9_]*') AS brand_is_name, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*') AS name_is_name FROM part")
def header_name_like(spark, d):
    f = F.col("fields")
    return sheet(spark, d, "part").select("p_partkey", cells.looks_like_name(cells.cell(f, 2)).alias("brand_is_name"), cells.looks_like_name(cells.cell(f, 1)).alias("name_is_name"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS shown FROM (SELECT doc_id, replace(replace(text, chr(10), '\\n'), chr(13), '\\r') AS t FROM documents)")
def render_truncated(spark, d):
    return sheet(spark, d, "documents").select("doc_id", cells.shown(cells.cell(F.col("fields"), 1)).alias("shown"))


@query("SELECT min(value) AS low, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS high FROM events")
def latency_percentiles(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").agg(F.min("value").alias("low"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("high"))


@query(f"SELECT len({URL_PIECES}) AS width, count(*) AS n FROM pages GROUP BY 1")
def width_profile(spark, d):
    return sheet(spark, d, "pages", cell=url_pieces()).groupBy(F.size("fields").cast("bigint").alias("width")).agg(F.count("*").alias("n"))


@query(f"SELECT max(w) AS max_width, arg_max(w, (n, w)) AS modal_width FROM (SELECT len({URL_PIECES}) AS w, count(*) AS n FROM pages GROUP BY 1)")
def modal_width(spark, d):
    widths = sheet(spark, d, "pages", cell=url_pieces()).groupBy(F.size("fields").cast("bigint").alias("w")).agg(F.count("*").alias("n"))
    return widths.agg(F.max("w").alias("max_width"), F.max_by("w", F.struct("n", "w")).alias("modal_width"))


@query("SELECT count(*) AS names, count(DISTINCT n_name) = count(*) AS distinct_names FROM nation")
def distinct_names(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").agg(F.count("*").alias("names"), (F.count_distinct("n_name") == F.count("*")).alias("distinct_names"))


# Delimited files ----------------------------------------------------------

_FILES: dict[tuple[str, str], str] = {}


def _fresh(spark: SparkSession) -> str:
    """A new name in the shared folder, whatever its file system is."""
    import uuid

    from .shared import shared_dir
    from .sources import files

    folder = f"{shared_dir(spark)}/sheets"
    store, root = files.filesystem(folder)
    store.create_dir(root, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}.csv"


def documents_file(spark: SparkSession, d: str):
    """``documents`` as a delimited file with a header, multi-line cells and quotes, opened; written once by session."""
    from .sheet import Sheet

    key = spark.sparkContext.applicationId, d
    if key not in _FILES:
        path, names = _fresh(spark), SHEETS["documents"][1]
        Sheet.from_dataframe(spark.read.parquet(f"{d}/documents.parquet").select(*names), ["doc_id"], names).save_as(path)
        _FILES[key] = path
    return Sheet.open(spark, _FILES[key], header="first-row", delimiter=b",")


def _saved(spark: SparkSession, changed):
    """What a changed sheet is when it has been written and opened again."""
    from .sheet import Sheet

    path = _fresh(spark)
    changed.save_as(path)
    return Sheet.open(spark, path, header="first-row", delimiter=b",")


def _read(rows: DataFrame, *names: str) -> DataFrame:
    """Cells of a file's rows as text; the second one, which is long, by its digest."""
    cell = [cells.lower(cells.cell(F.col("fields"), i)) for i in range(len(names))]
    more = [c for c in ("match",) if c in rows.columns]
    return rows.select("row", *more, *(F.md5(c).alias(n) if n == "digest" else F.decode(c, "UTF-8").alias(n) for c, n in zip(cell, names, strict=True)))


_DOCS = ("doc_id", "digest", "lang", "source")
_FILE = "SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents"
_SHOWN = "row, doc_id, md5(text) AS digest, lang, source"


@query("SELECT count(*) + 1 AS records FROM documents")
def file_index(spark, d):
    return spark.range(1).select(F.lit(documents_file(spark, d).count()).cast("bigint").alias("records"))


@query(f"SELECT {_SHOWN} FROM ({_FILE})")
def file_records(spark, d):
    return _read(documents_file(spark, d).rows_frame(), *_DOCS)


@query(f"SELECT {_SHOWN} FROM ({_FILE}) WHERE row BETWEEN 100 AND 149")
def file_range(spark, d):
    return _read(documents_file(spark, d).rows(100, 50), *_DOCS)


_FILE_MATCHES = f"SELECT *, row_number() OVER (ORDER BY row) - 1 AS match FROM ({_FILE}) WHERE contains(text, chr(10)) AND lang = 'de'"


def _german_lines(spark, d):
    return documents_file(spark, d).filter([Contains(1, "\n"), Equals(2, "de")])


@query(f"SELECT match, {_SHOWN} FROM ({_FILE_MATCHES}) WHERE match BETWEEN 3 AND 12")
def file_filtered_range(spark, d):
    return _read(_german_lines(spark, d).rows(3, 10), *_DOCS)


@query(f"SELECT match + 1 AS row, doc_id, md5(text) AS digest, lang, source FROM ({_FILE_MATCHES})")
def file_export(spark, d):
    from .sheet import Sheet

    path = _fresh(spark)
    _german_lines(spark, d).export(path)
    return _read(Sheet.open(spark, path, header="first-row", delimiter=b",").rows_frame(), *_DOCS)


@query(f"SELECT row, 1 AS \"column\" FROM ({_FILE}) WHERE contains(text, 'worthless') AND row >= 20 ORDER BY row LIMIT 1")
def file_search(spark, d):
    hit = documents_file(spark, d).find("worthless", (20, 0))
    return spark.createDataFrame([(hit.row, hit.column)] if hit else [], "row bigint, column int")


@query(f"""SELECT row, doc_id, md5(CASE row WHEN 3 THEN 'a "new", one' WHEN 50 THEN '' ELSE text END) AS digest, CASE row WHEN 7 THEN 'x' || chr(10) || 'é' ELSE lang END AS lang, source FROM ({_FILE})""")
def file_edit(spark, d):
    return _read(_saved(spark, documents_file(spark, d).edit({(3, 1): 'a "new", one', (7, 2): "x\né", (50, 1): ""})).rows_frame(), *_DOCS)


@query(f"SELECT row, doc_id, md5(replace(text, 'the', 'THE')) AS digest, lang, source FROM ({_FILE})")
def file_replace(spark, d):
    return _read(_saved(spark, documents_file(spark, d).replace_all("the", "THE")[0]).rows_frame(), *_DOCS)


@query(f"SELECT row, doc_id, md5(split_part(text, ' ', 1)) AS digest, CASE WHEN contains(text, ' ') THEN substr(text, instr(text, ' ') + 1) ELSE '' END AS rest, lang, source FROM ({_FILE})")
def file_split(spark, d):
    return _read(_saved(spark, documents_file(spark, d).split(1, " ", 2)).rows_frame(), "doc_id", "digest", "rest", "lang", "source")


@query(f"SELECT row, doc_id, md5(text) AS digest, source || '|' || lang AS joined FROM ({_FILE})")
def file_join(spark, d):
    return _read(_saved(spark, documents_file(spark, d).join([3, 2], "|")).rows_frame(), "doc_id", "digest", "joined")


@query(f"SELECT row_number() OVER (ORDER BY text DESC, row) AS row, doc_id, md5(text) AS digest, lang, source FROM ({_FILE})")
def file_sort(spark, d):
    return _read(_saved(spark, documents_file(spark, d).sort(1, True)[0]).rows_frame(), *_DOCS)


@query("SELECT doc_id::VARCHAR AS id, coalesce(lang, '') AS tongue FROM documents")
def file_rename_arrange(spark, d):
    out = _saved(spark, documents_file(spark, d).rename({0: "id", 2: "tongue"}).arrange([2, 0])).wide()
    return out.select(*(F.decode(cells.lower(F.col(c)), "UTF-8").alias(c) for c in ("id", "tongue")))


@query(f"""SELECT row, CASE WHEN row % 7 = 0 THEN doc_id || ',' || md5(coalesce(text, '')) || ',row ' || row || ',' || source ELSE NULL END AS edited, CASE WHEN row % 7 = 0 THEN NULL ELSE md5(doc_id || ',' || {_quote('text', ',')} || ',' || lang || ',' || source || chr(10)) END AS kept FROM ({_FILE})""")
def file_edit_many(spark, d):
    """Every seventh record edited, past what a plan holds as literals: the others keep their bytes."""
    source = documents_file(spark, d)
    changes = {(row, 2): f"row {row}" for row in range(7, source.count(), 7)}
    rows = _saved(spark, source.edit(changes)).rows_frame()
    f, seventh = F.col("fields"), F.col("row") % 7 == 0
    cell = lambda i: F.decode(cells.lower(cells.cell(f, i)), "UTF-8")
    edited = F.concat_ws(",", cell(0), F.md5(cells.lower(cells.cell(f, 1))), cell(2), cell(3))
    return rows.select("row", F.when(seventh, edited).alias("edited"), F.when(~seventh, F.md5(cells.lower(F.col("raw")))).alias("kept"))


@query(f"""SELECT count(*) + 1 AS records, CAST(sum(strlen(doc_id || ',' || {_quote('text', ',')} || ',' || lang || ',' || source) + 1) AS BIGINT) AS data_bytes, 'id,text,"the language, if known",source' AS header FROM ({_FILE})""")
def file_rename(spark, d):
    """A new header before bytes that stay as they are."""
    renamed = documents_file(spark, d).rename({0: "id", 2: "the language, if known"})
    path = _fresh(spark)
    rows, size = renamed.save_as(path)
    head = renamed.head_line()
    return spark.range(1).select(F.lit(rows).cast("bigint").alias("records"), F.lit(size - len(head)).cast("bigint").alias("data_bytes"), F.lit(head.decode().rstrip("\n")).alias("header"))


@query(f"SELECT count(*) + 1 AS records, count(*) FILTER (contains(text, 'the')) AS matches, CAST(sum(strlen(doc_id || ',' || {_quote('text', ',')} || ',' || lang || ',' || source) + 1) + strlen('doc_id,text,lang,source') + 1 AS BIGINT) AS bytes FROM ({_FILE})")
def file_live(spark, d):
    """A file opened while it's indexed, filtered while its parts are read: what is there at the end, and the bytes that progress counts."""
    from .streaming import live

    documents_file(spark, d)
    opened = live.LiveSheet(spark, _FILES[spark.sparkContext.applicationId, d], header="first-row", delimiter=b",").wait()
    found = live.filter_live(opened, [Contains(1, "the")])
    found.job.wait()
    return spark.range(1).select(F.lit(opened.count()).cast("bigint").alias("records"), F.lit(found.count()).cast("bigint").alias("matches"), F.lit(found.job.progress().bytes).cast("bigint").alias("bytes"))
