"""Documents, mappings, registries and stored sets as queries over the provided tables.

A query writes the provided tables in the form that an operator reads to the shared scratch
folder first, in many tasks, and reads them back through the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregates as agg
from ..operators import expressions as ex
from ..operators import joins, kpi
from ..operators import normalise as nm
from ..session import scratch_path, table
from ..sources import excel, files, snapshots, uploads
from .domain import load, rnd, sql
from .list_queries import mapping_issues
from .kpi_queries import CONFIG, pct
from .practice_queries import plain
from .registry_queries import _SNAP, _written
from .source_queries import FIELDS, _raw

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, d: plain(run(spark, d))
    ORACLE[name] = oracle


# --- documents -------------------------------------------------------------------------


def _document(spark, d):
    """Orders as one JSON document in one file, a row after the other; other arrays stand around them."""
    to = scratch_path(spark, "document")
    key, last = F.col("o_orderkey"), F.lit((1 << 62) + 1)
    row = F.to_json(F.struct("o_orderkey", "o_totalprice", F.concat(F.lit('a "quoted" } '), "o_orderpriority").alias("note"), F.struct(F.col("o_custkey").alias("id")).alias("client")))
    rows = table(spark, d, "orders").select(key.cast("long").alias("at"), F.concat(row, F.lit(",")).alias("value"))
    around = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("at"), F.lit('{"errors": [{"why": "]"}, {"why": "}"}], "data": [').alias("value")),
        F.struct(last.alias("at"), F.lit('null], "after": {"x": {"y": {}}}}').alias("value")),
    )).alias("r")).select("r.*")
    rows.unionByName(around).repartition(1).sortWithinPartitions("at").select("value").write.text(to)
    return files.read_json(spark, to, split_bytes=0)


add("src_02_split_document", lambda spark, d: _document(spark, d).select("o_orderkey", "o_totalprice", "note", F.col("client.id").alias("client_id")),
    "SELECT o_orderkey, o_totalprice, 'a \"quoted\" } ' || o_orderpriority AS note, o_custkey AS client_id FROM orders")


def _workbooks(spark, d):
    """Customers as workbooks, one a task, with numbers, booleans, shared and inline strings."""
    to = scratch_path(spark, "workbooks")
    to = to if "://" in to else f"file://{to}"
    spaces = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def write(rows):
        import uuid
        import zipfile
        from xml.sax.saxutils import escape

        from pyarrow import fs

        segments: dict[str, int] = {}
        where, folder = fs.FileSystem.from_uri(to)
        where.create_dir(folder, recursive=True)
        with where.open_output_stream(f"{folder}/{uuid.uuid4().hex}.xlsx", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("xl/workbook.xml", f'<workbook {spaces}><sheets><sheet name="Clients" sheetId="1" r:id="a"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in zip("ABCDE", ("Key", "Name", "Balance", "Segment", "Good")))
                sheet.write(f'<worksheet {spaces}><sheetData><row r="1">{head}</row>'.encode())
                for i, r in enumerate(rows, start=2):
                    shared = segments.setdefault(r["c_mktsegment"], len(segments))
                    sheet.write((
                        f'<row r="{i}"><c r="A{i}"><v>{r["c_custkey"]}</v></c><c r="B{i}" t="inlineStr"><is><t>{escape(r["c_name"])}</t></is></c><c r="C{i}"><v>{r["c_acctbal"]!r}</v></c>'
                        f'<c r="D{i}" t="s"><v>{shared}</v></c><c r="E{i}" t="b"><v>{int(r["c_acctbal"] > 0)}</v></c></row>').encode())
                sheet.write(b"</sheetData></worksheet>")
            book.writestr("xl/sharedStrings.xml", f"<sst {spaces}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in segments)}</sst>")

    table(spark, d, "customer").repartition(3, "c_custkey").foreachPartition(write)
    return excel.read_excel(spark, to, rows_per_task=1000)


def _excel(spark, d):
    """Read back with the types that the cells show."""
    df = _workbooks(spark, d)
    kinds = files.infer_types(df)
    return df.select(*[sc.coerce_detected(F.col(c), kinds[c]).alias(c.lower()) for c in ("Key", "Name", "Balance", "Segment", "Good")])


add("src_04_excel", _excel, "SELECT CAST(c_custkey AS DOUBLE) AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, c_acctbal > 0 AS good FROM customer")

# --- mappings --------------------------------------------------------------------------


def _fields(spark, d):
    """Brands as fields, in the order of their first part; those of even length are asked for."""
    name = F.concat(F.lit("field"), F.regexp_replace("p_brand", "#", ""))
    return table(spark, d, "part").groupBy(name.alias("field")).agg(F.min("p_partkey").alias("ordinal")).withColumn("required", F.length("field") % 2 == 0)


def _headers(spark, d):
    """Columns named after brands of parts: spelled as they are, by alias, as saved, misspelled, or not at all."""
    brand, k = F.regexp_replace("p_brand", "#", ""), F.col("p_partkey")
    name = (F.when(k % 6 == 0, F.concat(F.lit("Field_"), brand)).when(k % 6 == 1, F.concat(F.lit("Alias "), brand)).when(k % 6 == 2, F.concat(F.lit("Saved "), brand))
            .when(k % 6 == 3, F.concat(F.lit("Feild"), brand)).when(k % 6 == 4, F.concat(F.lit("fieldBran"), F.substr(brand, F.lit(6)))).otherwise(F.concat(F.lit("Other"), brand, F.lit("zz"))))
    return table(spark, d, "part").where("p_partkey % 5 < 3").select(name.alias("header")).distinct().withColumn("missing_percent", (F.length("header") * 7 % 100).cast("double")).withColumn("kind", F.lit("number"))


_BRANDS = [f"Brand{i}" for i in range(1, 26)]
_ALIASES, _SAVED = {f"alias{b.lower()}": f"field{b.lower()}" for b in _BRANDS}, {f"Saved {b}": f"field{b}" for b in _BRANDS}
_MAPPED = r"""f AS (SELECT 'field' || replace(p_brand, '#', '') AS field, min(p_partkey) AS ordinal FROM part GROUP BY 1),
h AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'Field_' || b WHEN 1 THEN 'Alias ' || b WHEN 2 THEN 'Saved ' || b WHEN 3 THEN 'Feild' || b WHEN 4 THEN 'fieldBran' || substr(b, 6) ELSE 'Other' || b || 'zz' END AS header
      FROM (SELECT p_partkey, replace(p_brand, '#', '') AS b FROM part WHERE p_partkey % 5 < 3)),
n AS (SELECT header, lower(regexp_replace(header, '[\s_\-.]+', '', 'g')) AS n FROM h),
x AS (SELECT header, n, (SELECT field FROM f WHERE lower(field) = n.n) AS e, (SELECT field FROM f WHERE n.n LIKE 'alias%' AND lower(field) = 'field' || substr(n.n, 6)) AS a,
        CASE WHEN header LIKE 'Saved %' THEN 'field' || substr(header, 7) END AS s, (SELECT arg_min(field, (levenshtein(lower(field), n.n), ordinal)) FROM f WHERE levenshtein(lower(field), n.n) <= 2) AS z FROM n),
m AS (SELECT header, coalesce(e, a, s, z) AS field, CASE WHEN e IS NOT NULL THEN 'exact' WHEN a IS NOT NULL THEN 'alias' WHEN s IS NOT NULL THEN 'template' WHEN z IS NOT NULL THEN 'fuzzy' ELSE 'unmapped' END AS how FROM x)"""
add("prj_01_levels", lambda spark, d: files.auto_map(_headers(spark, d), _fields(spark, d), _ALIASES, _SAVED),
    f"WITH {_MAPPED} SELECT header, field, how, coalesce(length(field) % 2 = 0, FALSE) AND field IN (SELECT field FROM f) AS required FROM m")
add("prj_01_report", lambda spark, d: files.mapping_report(files.auto_map(_headers(spark, d), _fields(spark, d).where("ordinal < 9"), _ALIASES, {}), _headers(spark, d), _fields(spark, d)),
    f"""WITH {_MAPPED.replace("FROM part GROUP BY 1)", "FROM part GROUP BY 1 HAVING min(p_partkey) < 9), f2 AS (SELECT DISTINCT 'field' || replace(p_brand, '#', '') AS field FROM part)").replace("CASE WHEN header LIKE 'Saved %' THEN 'field' || substr(header, 7) END AS s", "NULL AS s")}
    SELECT 'missing' AS issue, field AS name, NULL AS kind FROM f2 WHERE length(field) % 2 = 0 AND field NOT IN (SELECT field FROM m WHERE field IS NOT NULL)
    UNION ALL SELECT 'unmapped', header, NULL FROM m WHERE field IS NULL UNION ALL SELECT 'suggested', header, 'number' FROM m WHERE field IS NULL AND length(header) * 7 % 100 <= 50""")

add("prj_02_mapping_check", lambda spark, d: mapping_issues(
    files.auto_map(_headers(spark, d), _fields(spark, d), _ALIASES, _SAVED).where("field is not null").select("header", "field").unionByName(table(spark, d, "nation").select(F.col("n_name").alias("header"), F.concat(F.lit("no"), "n_name").alias("field"))),
    _fields(spark, d).select("field", "required")),
    f"""WITH {_MAPPED}, c AS (SELECT field, count(*) AS n FROM m WHERE field IS NOT NULL GROUP BY field)
    SELECT 'duplicate' AS issue, field FROM c WHERE n > 1 AND field IN (SELECT field FROM f) UNION ALL SELECT 'unknown', field FROM c WHERE field NOT IN (SELECT field FROM f)
    UNION ALL SELECT 'unknown', 'no' || n_name FROM nation UNION ALL SELECT 'missing', field FROM f WHERE length(field) % 2 = 0 AND field NOT IN (SELECT field FROM c)""")


def _uploaded_headers(spark, d):
    """Every order as an upload with one of four header rows."""
    lists = F.array(*[F.array(*map(F.lit, x)) for x in (["Matter Number", "matter_id", "Status", "department", "Budget"], ["Pay Model", "name", "email"], ["billable"], ["contact_id", "display.name"])])
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("upload"), F.when(k % 4 == 1, "csv").otherwise("json").alias("form"), F.explode(F.get(lists, (k % 4).cast("int"))).alias("header"))


add("src_12_detect", lambda spark, d: files.detect_datasets(_uploaded_headers(spark, d)),
    """SELECT o_orderkey AS upload, ['fullMattersJson', 'feeEarnerCsv', NULL, 'contactsJson'][o_orderkey % 4 + 1] AS kind, CAST([75, 35, 0, 40][o_orderkey % 4 + 1] AS BIGINT) AS score,
    ['high', 'medium', 'none', 'medium'][o_orderkey % 4 + 1] AS confidence FROM orders""")

# --- registries ------------------------------------------------------------------------


def _registry(spark, d):
    s, c, o, n = (table(spark, d, t) for t in ("supplier", "customer", "orders", "nation"))
    row = lambda df, entity, i, name: df.select(F.lit(entity).alias("entity"), F.col(i).cast("string").alias("id"), name.alias("name"))
    return (row(o.where("o_orderkey % 3 > 0"), "matter", "o_orderkey", F.concat(F.lit("M"), F.col("o_orderkey").cast("string")))
            .unionByName(row(s, "earner", "s_suppkey", F.concat(F.lit("Ann L"), F.col("s_suppkey").cast("string"))))
            .unionByName(row(c.where("c_custkey % 5 > 0"), "client", "c_custkey", F.col("c_name"))).unionByName(row(n, "department", "n_nationkey", F.col("n_name"))))


def _records(spark, d):
    """Line items that know either an id or a name of their matter, lawyer, client and department, both or neither."""
    k = F.col("l_linenumber") + F.col("l_orderkey")
    text = lambda c: F.col(c).cast("string")
    li = table(spark, d, "lineitem").where("l_linenumber <= 4").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    client, dept = F.format_string("CUSTOMER#%09d", "o_custkey"), F.concat(F.lit("nation_"), (F.col("l_suppkey") % 30).cast("string"))
    return li.select(
        "l_orderkey", "l_linenumber", F.when(k % 4 < 2, text("l_orderkey")).alias("matter_id"), F.when(k % 4 == 2, F.concat(F.lit("M"), text("l_orderkey"))).alias("matter_number"),
        F.when(k % 3 == 0, F.col("l_suppkey")).alias("lawyer_id"), F.when(k % 3 == 1, F.concat(F.lit("L"), text("l_suppkey"), F.lit(", ANN"))).when(k % 6 == 0, F.lit("own")).alias("lawyer_name"),
        F.when(k % 2 == 0, text("o_custkey")).alias("client_id"), F.when(k % 2 == 1, client).alias("display_name"),
        F.when(k % 5 == 0, (F.col("l_suppkey") % 30).cast("string")).alias("department_id"), F.when(k % 5 == 1, dept).alias("department"),
    )


add("jon_10_all_entities", lambda spark, d: joins.cross_reference(_records(spark, d), _registry(spark, d)).withColumn("cross_referenced", F.array_join("cross_referenced", ",")), """
WITH r AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_linenumber + l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS o, l_orderkey % 3 > 0 AS known, l_suppkey AS s, CAST(o_custkey AS VARCHAR) AS c, o_custkey % 5 > 0 AS client, l_suppkey % 30 AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 4)
SELECT l_orderkey, l_linenumber, CASE WHEN k % 4 < 2 OR k % 4 = 2 AND known THEN o END AS matter_id, CASE WHEN k % 4 = 2 OR k % 4 < 2 AND known THEN 'M' || o END AS matter_number,
  CASE WHEN k % 3 < 2 THEN s END AS lawyer_id, CASE WHEN k % 6 = 0 THEN 'own' WHEN k % 3 = 0 THEN 'Ann L' || s WHEN k % 3 = 1 THEN 'L' || s || ', ANN' END AS lawyer_name,
  CASE WHEN k % 2 = 0 OR client THEN c END AS client_id, CASE WHEN k % 2 = 1 THEN 'CUSTOMER#' || lpad(c, 9, '0') WHEN client THEN 'Customer#' || lpad(c, 9, '0') END AS display_name,
  CASE WHEN k % 5 = 0 OR k % 5 = 1 AND n < 25 THEN CAST(n AS VARCHAR) END AS department_id, CASE WHEN k % 5 = 1 THEN 'nation_' || n WHEN k % 5 = 0 AND n < 25 THEN 'NATION_' || n END AS department,
  concat_ws(',', CASE WHEN k % 4 = 2 AND known THEN 'matter_id' END, CASE WHEN k % 4 < 2 AND known THEN 'matter_number' END, CASE WHEN k % 3 = 1 THEN 'lawyer_id' END, CASE WHEN k % 6 = 3 THEN 'lawyer_name' END,
    CASE WHEN k % 2 = 1 AND client THEN 'client_id' END, CASE WHEN k % 2 = 0 AND client THEN 'display_name' END, CASE WHEN k % 5 = 1 AND n < 25 THEN 'department_id' END, CASE WHEN k % 5 = 0 AND n < 25 THEN 'department' END) AS cross_referenced
FROM r""")

# --- measures and formulas -------------------------------------------------------------

add("agg_14_prices", lambda spark, d: agg.summarise(table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") < 5, F.col("l_extendedprice")).alias("x")), "x").select("median", "least", "most", "present", "missing"),
    "SELECT median(x) AS median, min(x) AS least, max(x) AS most, count(x) AS present, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS missing FROM (SELECT CASE WHEN l_linenumber < 5 THEN l_extendedprice END AS x FROM lineitem)")


def _bound(spark, d):
    """The burn of each matter's budget against that of matter 8, and the work in progress that it was made of."""
    p = load(spark, d)
    results = kpi.kpi_rows(p, CONFIG, additional=True).where("entity_type = 'matter'")
    reference = lambda **more: {"type": "formula", "id": "F-BS-01", **more}
    tree = {"type": "operator", "operator": "add", "left": {"type": "operator", "operator": "subtract", "left": reference(entityBinding="self"), "right": reference(entityBinding="8")},
            "right": {"type": "operator", "operator": "average", "left": reference(valueKey="wip"), "right": reference(entityBinding="8", valueKey="wip")}}
    return ex.evaluate(tree, p.matters, "matter_id", results=results, after={"round": 3})


add("exp_bound_references", _bound, sql(f"""SELECT CAST(matter_id AS VARCHAR) AS entity_id, {rnd('b - (SELECT b FROM x WHERE matter_id = 8) + coalesce((w + (SELECT w FROM x WHERE matter_id = 8)) / 2, w, (SELECT w FROM x WHERE matter_id = 8))', 3)} AS value FROM x""",
    f"x AS (SELECT matter_id, CAST(wip AS DOUBLE) AS w, CASE WHEN budget > 0 THEN {rnd(pct('coalesce(wip, 0)', 'budget'))} END AS b FROM ma LEFT JOIN (SELECT matter_id, sum(CASE WHEN matched THEN billable_value ELSE 0 END) AS wip FROM te GROUP BY matter_id) USING (matter_id))"))

# --- stored snapshots ------------------------------------------------------------------

add("qry_08_formula", lambda spark, d: snapshots.formula_kpis(spark, _written(spark, d), "firm-1", "F-WL-02").select("entity_type", "entity_id", "kpi_value", "rag_status", "display_value"),
    f"SELECT entity_type, entity_id, kpi_value, rag_status, display_value FROM ({_SNAP}) WHERE kpi_key = 'F-WL-02'")
add("qry_08_entity", lambda spark, d: snapshots.entity_kpis(spark, _written(spark, d), "firm-1", "matter", "8").select("kpi_key", "kpi_value", "rag_status", "display_value"),
    f"SELECT kpi_key, kpi_value, rag_status, display_value FROM ({_SNAP}) WHERE entity_type = 'matter' AND entity_id = '8'")
_COUNTS = ", ".join(f"CAST(count(*) FILTER (rag_status = '{s}') AS BIGINT) AS {s}" for s in ("green", "amber", "red", "neutral"))
add("qry_08_rag_summary", lambda spark, d: snapshots.rag_summary(snapshots.scan(spark, _written(spark, d), "firm-1")),
    f"SELECT coalesce(kpi_key, 'all') AS kpi_key, {_COUNTS} FROM ({_SNAP}) GROUP BY GROUPING SETS ((kpi_key), ())")

# --- stored sets -----------------------------------------------------------------------


def _committed(spark, d):
    """Typed orders, kept and rejected rows in one write; a second write with mostly rejected rows changes nothing."""
    to = scratch_path(spark, "judged")
    rows = nm.coerce(nm.remap(_raw(spark, d), {"Order Id": "id", "Price": "budget"}), FIELDS)
    uploads.commit_judged(nm.judged(rows, FIELDS, strict=True), to)
    try:
        uploads.commit_judged(nm.judged(rows.withColumn("budget", F.when(F.col("id") < 9, F.col("budget"))), FIELDS, strict=True), to)
    except uploads.TooManyRejected:
        pass
    kept, gone = uploads.committed(spark, to), uploads.committed(spark, to, "rejected")
    return kept.select(F.lit("kept").alias("outcome"), "id").unionByName(gone.select(F.col("reject").alias("outcome"), "id")).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


add("flt_03_commit", _committed, """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'missing budget' ELSE 'kept' END AS outcome, count(*) AS n, CAST(sum(o_orderkey) AS DOUBLE) AS ids FROM orders GROUP BY 1
UNION ALL SELECT 'blank row', count(*), NULL FROM region""")


def _reprocessed(spark, d):
    """One upload under two mappings: the second takes its amount from another column and drops the flag."""
    root = scratch_path(spark, "uploads")
    k = F.col("o_orderkey")
    raw = table(spark, d, "orders").select(k.cast("string").alias("Ref"), F.col("o_custkey").cast("string").alias("Net"), F.concat(F.lit("£"), (F.col("o_custkey") * 2).cast("string")).alias("Gross"), F.when(k % 2 == 0, "yes").otherwise("no").alias("Paid"))
    uploads.store_raw(raw, root, "firm-1", "invoice")
    out = None
    for mapping in ({"Ref": "id", "Net": "budget", "Gross": None, "Paid": "flag"}, {"Ref": "id", "Net": None, "Gross": "budget", "Paid": None}):
        uploads.store_mapping(spark, root, "firm-1", "invoice", mapping)
        version = uploads.reprocess(spark, root, "firm-1", "invoice", FIELDS, "2001-08-15")
        stale = uploads.is_stale(spark, root, "firm-1")
        uploads.mark(spark, root, "firm-1", False, "2001-08-16")  # what a calculation does
        rows = uploads.derived(spark, root, "firm-1", "invoice", version=version)
        flags = F.count_if("flag") if "flag" in rows.columns else F.lit(None).cast("long")
        one = rows.agg(F.lit(version).cast("long").alias("version"), F.count("*").alias("n"), F.sum("budget").alias("budget"), flags.alias("flags"), F.lit(stale).alias("was_stale"), F.lit(uploads.is_stale(spark, root, "firm-1")).alias("is_stale"))
        out = one if out is None else out.unionByName(one)
    return out


add("qry_16_reprocess", _reprocessed, """SELECT CAST(1 AS BIGINT) AS version, count(*) AS n, CAST(sum(o_custkey) AS DOUBLE) AS budget, CAST(count(*) FILTER (o_orderkey % 2 = 0) AS BIGINT) AS flags, TRUE AS was_stale, FALSE AS is_stale FROM orders
UNION ALL SELECT 2, count(*), CAST(sum(o_custkey * 2) AS DOUBLE), NULL, TRUE, FALSE FROM orders""")
