"""Ingest, standardisation, roll-up and audit queries."""

from pyspark.sql import functions as F

from cellwise.functions import codes as C
from cellwise.functions import measures as M
from cellwise.operators import audit, mapping, rollup
from cellwise.plans import base as B
from cellwise.plans.registry import query
from cellwise.session import freeze, scratch_path, table
from cellwise.sources import files, loads, sinks

ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "year"]


def order_text(spark, folder):
    """Orders as an all-text source row, the way a landed file holds them."""
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    return orders.select(*[F.col(c).cast("string").alias(c) for c in ORDER_FIELDS])


def landed_orders(spark, folder):
    path = scratch_path(spark, "landed-orders")
    order_text(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv_strings(spark, path, ORDER_FIELDS)


# --- A: scans, loads, sinks


@query(
    "csv_string_scan",
    """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority,
       CAST(year(o_orderdate) AS INT) AS year FROM orders""",
)
def csv_string_scan(spark, folder):
    rows = files.require_columns(landed_orders(spark, folder), ORDER_FIELDS, "orders")
    return rows.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        F.col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderstatus",
        F.round(M.parse_measure(F.col("o_totalprice")), 2).alias("o_totalprice"),
        "o_orderpriority",
        F.col("year").cast("int").alias("year"),
    )


@query(
    "row_field_validation",
    """SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS bad_year, CAST(0 AS BIGINT) AS blank_key,
       count(*) FILTER (WHERE length(CAST(o_custkey AS VARCHAR)) <> 3) AS bad_width,
       count(*) FILTER (WHERE NOT year(o_orderdate) BETWEEN 1996 AND 2000) AS outside_window,
       count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS other_category FROM orders""",
)
def row_field_validation(spark, folder):
    rows = files.require_rows(order_text(spark, folder), "orders")
    return files.field_failures(
        rows,
        {
            "bad_year": files.is_year(F.col("year")),
            "blank_key": M.not_blank(F.col("o_orderkey")),
            "bad_width": F.length("o_custkey") == 3,
            "outside_window": F.col("year").cast("int").between(1996, 2000),
            "other_category": F.col("o_orderpriority") == "1-URGENT",
        },
    )


@query(
    "validation_routing",
    """SELECT CASE WHEN NOT year(o_orderdate) BETWEEN 1996 AND 2000 THEN 'outside_window'
                   WHEN length(CAST(o_custkey AS VARCHAR)) <> 3 THEN 'bad_width' ELSE 'accepted' END AS outcome,
       count(*) AS row_count FROM orders GROUP BY 1""",
)
def validation_routing(spark, folder):
    rules = {
        "outside_window": F.col("year").cast("int").between(1996, 2000),
        "bad_width": F.length("o_custkey") == 3,
    }
    good, bad = files.route(order_text(spark, folder), rules)
    both = good.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "extract_slice_counts",
    """SELECT o_orderstatus, count(*) AS rows_read,
       count(*) FILTER (WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND o_orderpriority = '1-URGENT') AS rows_selected
       FROM orders GROUP BY 1""",
)
def extract_slice_counts(spark, folder):
    rows = table(spark, folder, "orders")
    year = F.year("o_orderdate")
    picked = files.extract_slice(rows, year, 1996, 1999, F.col("o_orderpriority"), "1-URGENT")
    read = rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows_read"))
    kept = picked.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows_selected"))
    return read.join(kept, "o_orderstatus", "left").select(
        "o_orderstatus", "rows_read", F.coalesce("rows_selected", F.lit(0).cast("bigint")).alias("rows_selected")
    )


@query(
    "member_area_extract",
    """SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS area, CAST(year(l_shipdate) AS INT) AS yr,
       count(*) AS row_count, round(sum(l_extendedprice), 2) AS pay
       FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber = 1 AND l_returnflag IN ('A', 'R')
         AND substr(lpad(CAST(l_suppkey AS VARCHAR), 5, '0'), 3, 3) NOT IN ('000', '999')
       GROUP BY 1, 2""",
)
def member_area_extract(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        C.normalize_code(F.col("l_suppkey").cast("string"), 5).alias("area"),
        "l_linestatus",
        F.col("l_linenumber").cast("string").alias("size_code"),
        F.lit("A").alias("qtr"),
        "l_returnflag",
        F.when(F.year("l_shipdate") >= 1998, F.col("l_extendedprice")).alias("annual_pay"),
        F.when(F.year("l_shipdate") < 1998, F.col("l_extendedprice")).alias("pay_old_name"),
        B.year_of("l_shipdate"),
    )
    picked = files.member_extract(
        rows, "area", ("l_linestatus", "O"), ("size_code", "1"), ("qtr", "A"), "l_returnflag", ["A", "R"],
        {"annual_pay": "pay_old_name"},
    )
    return picked.groupBy("area", "yr").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("annual_pay"), 2).alias("pay")
    )


@query(
    "wide_pairs_to_long",
    B.with_sql(B.CONTROL_SQL, B.GEO_SQL)
    + " UNION ALL ".join(
        f"SELECT l.geo, yr, '{c}' AS control_name, round({c}, 6) AS estimate, {c}_moe AS margin "
        "FROM control_layer l JOIN geo_dim g ON g.geo = l.geo WHERE contains(geo_name, 'NATION_1')"
        for c in B.CONTROLS
    ),
)
def wide_pairs_to_long(spark, folder):
    long = B.control_long(spark, folder)
    named = B.geo_dim(spark, folder).filter(F.col("geo_name").contains("NATION_1")).select("geo")
    return B.rounded(long.join(named, "geo"))


@query(
    "normalised_flags_geoid",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'N' ELSE '' END AS flag,
       lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS geoid,
       c_acctbal < 0 AS has_flag, CASE WHEN c_acctbal < 0 THEN '{"flag":"N"}' END AS flags_json
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def normalised_flags_geoid(spark, folder):
    nation = table(spark, folder, "nation").select(
        "n_nationkey", F.col("n_regionkey").cast("string").alias("state")
    )
    rows = (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey", F.when(F.col("c_acctbal") < 0, " N").alias("flag"), "state",
            F.col("c_nationkey").cast("string").alias("county"),
        )
    )
    return files.normalised_flags(rows, ["flag"], "state", "county").select(
        "c_custkey", "flag", "geoid",
        M.any_not_blank(["flag"]).alias("has_flag"),
        M.flag_json(["flag"]).alias("flags_json"),
    )


@query(
    "raw_rows_with_payload",
    """SELECT 'bds|year=' || year(o_orderdate) || '|o_custkey=' || o_custkey || '|o_orderkey=' || o_orderkey AS identifier,
       '{"o_custkey":"' || o_custkey || '","o_orderkey":"' || o_orderkey || '","o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' ||
       CASE o_orderstatus WHEN 'P' THEN 'D' WHEN 'O' THEN 'X' ELSE o_orderstatus END || '","year":"' || year(o_orderdate) || '"}' AS raw_payload,
       o_orderstatus = 'P' AS has_suppression, o_orderstatus IN ('P', 'O') AS has_status FROM orders""",
)
def raw_rows_with_payload(spark, folder):
    rows = order_text(spark, folder).drop("o_totalprice").withColumn(
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", "D").when(F.col("o_orderstatus") == "O", "X").otherwise(F.col("o_orderstatus")),
    )
    columns = rows.columns
    return rows.select(
        C.row_identifier("bds", ["year", "o_custkey", "o_orderkey"]).alias("identifier"),
        M.payload_json(columns).alias("raw_payload"),
        M.any_code(columns, M.SUPPRESSION_CODES).alias("has_suppression"),
        M.any_code(columns).alias("has_status"),
    )


@query(
    "idempotent_append",
    """SELECT o_orderstatus, count(*) * 2 AS rows_read,
       CASE WHEN o_orderstatus = 'F' THEN 0 ELSE count(*) END AS rows_inserted,
       CASE WHEN o_orderstatus = 'F' THEN count(*) * 2 ELSE count(*) END AS rows_skipped,
       count(*) AS rows_stored FROM orders GROUP BY 1""",
)
def idempotent_append(spark, folder):
    """Load one status, then a file holding every order twice; nothing is stored twice."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "raw-orders")
    identity = ["o_orderkey"]
    loads.append_new(rows.filter("o_orderstatus = 'F'"), path, identity, None)
    stored = spark.read.parquet(path)
    incoming = rows.unionAll(rows)
    counts = freeze(loads.load_counts(incoming, stored, identity, ["o_orderstatus"]))
    loads.append_new(incoming, path, identity, stored)
    loads.append_new(incoming, path, identity, spark.read.parquet(path))
    final = spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows_stored"))
    return counts.join(final, "o_orderstatus")


@query("data_file_manifest")
def data_file_manifest(spark, folder):
    return loads.data_manifest(spark, f"{folder}/orders.parquet", "orders")


@query("landed_file_manifest")
def landed_file_manifest(spark, folder):
    path = scratch_path(spark, "landed-manifest")
    order_text(spark, folder).write.option("header", True).csv(path)
    found = loads.file_manifest(spark, path, "orders", "*.csv")
    known = found.limit(0).select("source", "file_name", "sha256")
    return loads.register_manifest(found, known)


@query(
    "dimension_upsert",
    """WITH both_versions AS (
         SELECT c_custkey, c_mktsegment, c_acctbal, 1 AS version FROM customer
         UNION ALL
         SELECT c_custkey, 'REVISED', c_acctbal + 100, 2 FROM customer WHERE c_nationkey < 5
         UNION ALL
         SELECT c_custkey + 1000000, c_mktsegment, c_acctbal, 2 FROM customer WHERE c_nationkey = 7)
       SELECT c_custkey, arg_max(c_mktsegment, version) AS c_mktsegment,
              round(arg_max(c_acctbal, version), 2) AS c_acctbal, CAST(max(version) AS INT) AS version
       FROM both_versions GROUP BY 1""",
)
def dimension_upsert(spark, folder):
    base = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    existing = base.drop("c_nationkey").withColumn("version", F.lit(1))
    changed = base.filter("c_nationkey < 5").select(
        "c_custkey", F.lit("REVISED").alias("c_mktsegment"), (F.col("c_acctbal") + 100).alias("c_acctbal"),
        F.lit(2).alias("version"),
    )
    added = base.filter("c_nationkey = 7").select(
        (F.col("c_custkey") + 1000000).alias("c_custkey"), "c_mktsegment", "c_acctbal", F.lit(2).alias("version")
    )
    merged = loads.upsert(existing, changed.unionByName(added), ["c_custkey"], F.col("version"))
    return merged.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    "bounded_panel_scan",
    B.with_sql(B.START_LAYER_SQL)
    + "SELECT geo, ind, yr, round(start_rate, 6) AS start_rate FROM start_layer WHERE yr <= 2000 AND yr IN (1996, 1998, 2000, 2001)",
)
def bounded_panel_scan(spark, folder):
    path = scratch_path(spark, "start-panel")
    sinks.write_table(B.start_layer(spark, folder), path, ["yr"])
    stored = spark.read.parquet(path)
    return B.rounded(
        sinks.bounded_scan(stored, "yr", [*B.KEY, "start_rate"], last=2000, years=(1996, 1998, 2000, 2001))
    )


@query(
    "ordered_csv_export",
    B.with_sql(B.START_LAYER_SQL)
    + "SELECT geo, ind, yr, round(start_rate, 4) AS start_rate FROM start_layer",
)
def ordered_csv_export(spark, folder):
    path = scratch_path(spark, "export")
    rows = B.start_layer(spark, folder).select(*B.KEY, F.round("start_rate", 4).alias("start_rate"))
    sinks.export_csv(rows, path, ["yr", "geo", "ind"])
    back = files.read_csv_strings(spark, path, rows.columns)
    return back.select(
        F.col("geo").cast("int").alias("geo"), "ind", F.col("yr").cast("int").alias("yr"),
        M.parse_measure(F.col("start_rate")).alias("start_rate"),
    )


MART_TYPES = {"geo": "smallint", "ind": "string", "yr": "smallint", "start_rate": "double", "is_suppressed": "boolean"}


@query(
    "typed_mart_write",
    B.with_sql(B.START_LAYER_SQL)
    + """SELECT CAST(geo AS SMALLINT) AS geo, ind, CAST(yr AS SMALLINT) AS yr,
         round(start_rate, 6) AS start_rate, is_suppressed FROM start_layer""",
)
def typed_mart_write(spark, folder):
    path = scratch_path(spark, "mart")
    sinks.write_table(sinks.enforce_types(B.start_layer(spark, folder), MART_TYPES), path)
    return B.rounded(spark.read.parquet(path))


@query(
    "dataset_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, count(*) AS row_count, CAST({n} AS INT) AS column_count, '{k}' AS key_columns FROM {t}"
        for t, n, k in (
            ("customer", 5, "c_custkey"), ("orders", 6, "o_orderkey"), ("lineitem", 11, "l_orderkey,l_linenumber"),
            ("supplier", 4, "s_suppkey"),
        )
    ),
)
def dataset_inventory(spark, folder):
    keys = {
        "customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
        "supplier": ["s_suppkey"],
    }
    return sinks.inventory({t: (table(spark, folder, t), k) for t, k in keys.items()})


@query(
    "geography_dimension",
    """SELECT lpad(CAST(r_regionkey AS VARCHAR), 5, '0') AS group_code, r_name AS group_name,
       CASE WHEN r_regionkey = 4 THEN 'MICROPOLITAN' ELSE 'MSA' END AS group_type,
       string_agg(DISTINCT lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), ',' ORDER BY lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS states,
       count(DISTINCT c_custkey) AS member_count
       FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""",
)
def geography_dimension(spark, folder):
    rows = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            C.normalize_code(F.col("r_regionkey").cast("string"), 5).alias("group_code"),
            F.col("r_name").alias("group_name"),
            C.place_type(
                F.when(F.col("r_regionkey") == 4, "Micropolitan Statistical Area").otherwise("Metropolitan Statistical Area")
            ).alias("group_type"),
            F.col("n_nationkey").cast("string").alias("state"),
            F.col("c_custkey").cast("string").alias("county"),
        )
    )
    groups = mapping.group_dimension(rows, "group_code", "group_name", "group_type", "state")
    members = mapping.member_dimension(rows, "group_code", "state", "county")
    counts = members.groupBy("group_code").agg(F.count(F.lit(1)).alias("member_count"))
    return groups.join(counts, "group_code")


# --- B: scalar functions

_TEXTS = """texts AS (
  SELECT geo, ind, yr, backbone, starts,
         CASE WHEN backbone < 10 THEN 'D' WHEN backbone < 12 THEN ' S ' WHEN backbone = 13 THEN ''
              WHEN backbone = 14 THEN backbone || 'D' ELSE ' ' || backbone || '.5' END AS backbone_text,
         CASE WHEN starts = 0 THEN '-666666666' WHEN starts = 1 THEN '-888888888' ELSE CAST(starts - 3 AS VARCHAR) END AS starts_text
  FROM start_counts)"""


def coded_texts(spark, folder):
    n, s = F.col("backbone"), F.col("starts")
    return B.start_counts(spark, folder).select(
        *B.KEY, "backbone", "starts",
        F.when(n < 10, "D").when(n < 12, " S ").when(n == 13, "").when(n == 14, F.concat(n.cast("string"), F.lit("D")))
        .otherwise(F.concat(F.lit(" "), n.cast("string"), F.lit(".5"))).alias("backbone_text"),
        F.when(s == 0, "-666666666").when(s == 1, "-888888888").otherwise((s - 3).cast("string")).alias("starts_text"),
    )


@query(
    "suppression_aware_parse",
    B.with_sql(B.START_COUNTS_SQL, _TEXTS)
    + """SELECT geo, ind, yr,
       CASE WHEN backbone < 12 OR backbone IN (13, 14) THEN NULL ELSE backbone + 0.5::DOUBLE END AS measure,
       CASE WHEN starts >= 2 THEN (starts - 3)::DOUBLE END AS estimate,
       CASE WHEN starts >= 3 THEN (starts - 3)::DOUBLE END AS margin,
       (backbone < 12 OR backbone IN (13, 14) OR starts < 2) AS has_missing,
       CASE WHEN backbone >= 12 AND backbone NOT IN (13, 14) AND starts >= 2
            THEN round(100 * (starts - 3)::DOUBLE / (backbone + 0.5::DOUBLE), 6) END AS rate,
       coalesce(starts >= 2 AND starts < 3, FALSE) AS invalid_pct FROM texts""",
)
def suppression_aware_parse(spark, folder):
    parsed = coded_texts(spark, folder).withColumns(
        {
            "measure": M.parse_measure(F.col("backbone_text")),
            "estimate": M.parse_estimate(F.col("starts_text")),
            "margin": M.parse_margin(F.col("starts_text")),
        }
    )
    return B.rounded(
        parsed.select(
            *B.KEY, "measure", "estimate", "margin",
            M.any_null(["measure", "estimate"]).alias("has_missing"),
            M.percent_of(F.col("estimate"), F.col("measure")).alias("rate"),
            F.coalesce(M.invalid_percent(["estimate"]), F.lit(False)).alias("invalid_pct"),
        )
    )


_CODES = """codes AS (
  SELECT DISTINCT CASE WHEN p_partkey % 10 < 2 THEN substr(CAST(10 + p_size AS VARCHAR), 1, 2)
              ELSE substr(CAST(10 + p_size AS VARCHAR) || lpad(CAST(p_partkey AS VARCHAR), 4, '0'), 1, 2 + CAST(p_partkey % 5 AS INT)) END AS code,
         p_name FROM part
  UNION ALL SELECT DISTINCT '31-33', 'Makers T' FROM part UNION ALL SELECT DISTINCT '44-45', 'Sellers' FROM part)"""


def part_codes(spark, folder):
    """Codes of two to six digits from part sizes and keys, plus two range codes."""
    part = table(spark, folder, "part")
    sector = (F.col("p_size") + 10).cast("string")
    full = F.concat(sector, F.lpad(F.col("p_partkey").cast("string"), 4, "0"))
    length = (F.lit(2) + F.col("p_partkey") % 5).cast("int")
    code = F.when(F.col("p_partkey") % 10 < 2, sector).otherwise(full.substr(F.lit(1), length))
    rows = part.select(code.alias("code"), "p_name")
    ranges = part.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(t).alias("p_name")) for c, t in (("31-33", "Makers T"), ("44-45", "Sellers"))]))
    ).distinct()
    return rows.unionByName(ranges)


@query(
    "sector_rollup_and_vintage",
    """WITH c AS (SELECT substr(CAST(10 + p_size AS VARCHAR) || lpad(CAST(p_partkey AS VARCHAR), 4, '0'), 1, 6) AS code, p_partkey % 14 + 2010 AS y FROM part)
       SELECT CASE WHEN substr(code, 1, 2) IN ('31', '32', '33') THEN '31-33' WHEN substr(code, 1, 2) IN ('44', '45') THEN '44-45'
                   WHEN substr(code, 1, 2) IN ('48', '49') THEN '48-49' ELSE substr(code, 1, 2) END AS sector,
              CASE WHEN y = 2010 THEN '2007' WHEN y <= 2016 THEN '2012' WHEN y <= 2021 THEN '2017' ELSE '2022' END AS qcew_vintage,
              CASE WHEN y <= 2011 THEN '2007' WHEN y <= 2016 THEN '2012' ELSE '2017' END AS cbp_vintage,
              CASE WHEN y >= 2022 THEN 'none' ELSE 'official_concordance_audit' END AS requirement, count(*) AS row_count
       FROM c GROUP BY 1, 2, 3, 4""",
)
def sector_rollup_and_vintage(spark, folder):
    rows = table(spark, folder, "part").select(
        F.concat((F.col("p_size") + 10).cast("string"), F.lpad(F.col("p_partkey").cast("string"), 4, "0")).alias("code"),
        (F.col("p_partkey") % 14 + 2010).alias("y"),
    )
    vintage = C.vintage_of(F.lit("QCEW"), F.col("y"))
    return rows.groupBy(
        C.sector_of(F.col("code")).alias("sector"),
        vintage.alias("qcew_vintage"),
        C.vintage_of(F.lit("CBP"), F.col("y")).alias("cbp_vintage"),
        C.mapping_requirement(vintage).alias("requirement"),
    ).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "classification_dimension",
    f"""WITH {_CODES},
       valid AS (SELECT code, CASE WHEN contains(code, '-') THEN 2 ELSE length(code) END AS level FROM codes
                 WHERE regexp_full_match(code, '[0-9]{{2,6}}') OR regexp_full_match(code, '[0-9]{{2}}-[0-9]{{2}}') GROUP BY 1, 2),
       longest AS (SELECT v.code, arg_max(p.code, length(p.code)) AS parent FROM valid v JOIN valid p
                   ON length(p.code) >= 2 AND length(p.code) < length(v.code) AND NOT contains(p.code, '-') AND NOT contains(v.code, '-')
                   AND starts_with(v.code, p.code) GROUP BY 1)
       SELECT v.code, CAST(v.level AS INT) AS level, coalesce(l.parent, r.code) AS parent, trim(regexp_replace(t.title, 'T$', '')) AS title,
         CASE WHEN ends_with(t.title, 'T') THEN 'Title carried a marker.' END AS note
       FROM valid v JOIN (SELECT code, min(p_name) AS title FROM codes GROUP BY 1) t ON t.code = v.code LEFT JOIN longest l ON l.code = v.code
       LEFT JOIN valid r ON contains(r.code, '-') AND v.level > 2 AND CAST(substr(v.code, 1, 2) AS INT) BETWEEN CAST(substr(r.code, 1, 2) AS INT) AND CAST(substr(r.code, 4, 2) AS INT)""",
)
def classification_dimension(spark, folder):
    dim = mapping.classification(part_codes(spark, folder), "code", "p_name")
    return dim.select("code", F.col("level").cast("int").alias("level"), "parent", "title", "note")


# --- C and D: mapping, roll-up, audits


@query(
    "place_crosswalk_status",
    """SELECT status, count(*) AS code_count, CAST(sum(n) AS BIGINT) AS row_count FROM (
         SELECT code, n, CASE WHEN s.s_suppkey IS NOT NULL AND s.s_nationkey < 20 THEN 'crosswalk_required'
                WHEN g.g IS NOT NULL THEN 'direct_match' ELSE 'unresolved' END AS status
         FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'G' || (l_suppkey % 40) ELSE CAST(l_suppkey AS VARCHAR) END AS code, count(*) AS n FROM lineitem GROUP BY 1)
         LEFT JOIN supplier s ON CAST(s.s_suppkey AS VARCHAR) = code AND s.s_nationkey < 20
         LEFT JOIN (SELECT DISTINCT 'G' || n_nationkey AS g FROM nation) g ON g.g = code) GROUP BY 1""",
)
def place_crosswalk_status(spark, folder):
    supplier = table(spark, folder, "supplier").filter("s_nationkey < 20")
    members = supplier.select(
        F.col("s_suppkey").cast("string").alias("member"),
        F.concat(F.lit("G"), F.col("s_nationkey").cast("string")).alias("group"),
    )
    groups = table(spark, folder, "nation").select(F.concat(F.lit("G"), F.col("n_nationkey").cast("string")).alias("group"))
    rows = table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("G"), (F.col("l_suppkey") % 40).cast("string")))
        .otherwise(F.col("l_suppkey").cast("string")).alias("code")
    )
    classified = mapping.classify_place(rows, "code", members, groups)
    return audit.mapping_audit(classified, "code", "place_status").withColumnRenamed("place_status", "status")


@query(
    "exact_category_status",
    """SELECT CASE WHEN CAST(substr(p_brand, 7) AS INT) <= 15 THEN 'directly_comparable' ELSE 'unresolved' END AS category_status,
       count(DISTINCT p_brand) AS code_count, count(*) AS row_count FROM part GROUP BY 1""",
)
def exact_category_status(spark, folder):
    part = table(spark, folder, "part")
    dimension = part.filter(F.substring("p_brand", 7, 3).cast("int") <= 15).select("p_brand")
    return audit.mapping_audit(
        mapping.classify_exact(part.select("p_brand"), "p_brand", dimension, "p_brand"), "p_brand", "category_status"
    )


_FIRST_WORD = "split_part(p_name, ' ', 1)"
_LAST_WORD = "split_part(p_name, ' ', 2)"


@query(
    "concordance_chain",
    f"""WITH a AS (SELECT DISTINCT p_brand AS o, p_type AS n FROM part), b AS (SELECT DISTINCT p_type AS o, {_FIRST_WORD} AS n FROM part),
       c AS (SELECT DISTINCT {_FIRST_WORD} AS o, {_LAST_WORD} AS n FROM part)
       SELECT DISTINCT a.o AS old, c.n AS new FROM a JOIN b ON b.o = a.n JOIN c ON c.o = b.n""",
)
def concordance_chain(spark, folder):
    part = table(spark, folder, "part")
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    return mapping.chain(
        [
            part.select(F.col("p_brand").alias("old"), F.col("p_type").alias("new")),
            part.select(F.col("p_type").alias("old"), first.alias("new")),
            part.select(first.alias("old"), last.alias("new")),
        ]
    )


@query(
    "missing_handoffs",
    """SELECT DISTINCT p_type AS code FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 45 AND p_retailprice < 1000)""",
)
def missing_handoffs(spark, folder):
    part = table(spark, folder, "part")
    return mapping.missing_handoffs(
        part.select(F.col("p_brand").alias("old"), F.col("p_type").alias("new")),
        part.filter("p_size > 45 AND p_retailprice < 1000").select(F.col("p_type").alias("old"), F.col("p_name").alias("new")),
    )


_RELATIONS = """relations AS (
  SELECT DISTINCT c_mktsegment AS old, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION'
         WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'HOME'
         WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN 'TOOLS' ELSE c_mktsegment END AS new FROM customer),
accepted AS (
  SELECT old AS source_code,
         CASE WHEN nt = 1 AND ns = 1 AND old = tgt THEN 'directly_comparable' WHEN nt = 1 AND ns = 1 THEN 'official_mapping_required' ELSE 'unresolved' END AS category_status,
         CASE WHEN nt = 1 AND ns = 1 THEN tgt END AS target_code
  FROM (SELECT old, count(*) AS nt, min(new) AS tgt FROM relations GROUP BY 1) f
  JOIN (SELECT new, count(*) AS ns FROM relations GROUP BY 1) b ON b.new = f.tgt)"""


def segment_relations(spark, folder):
    seg = F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        seg.alias("old"),
        F.when(seg == "BUILDING", "CONSTRUCTION").when(seg.isin("FURNITURE", "HOUSEHOLD"), "HOME")
        .when((seg == "MACHINERY") & (F.col("c_acctbal") < 0), "TOOLS").otherwise(seg).alias("new"),
    )


@query("reciprocal_concordance", f"WITH {_RELATIONS} SELECT * FROM accepted")
def reciprocal_concordance(spark, folder):
    return mapping.reciprocal(segment_relations(spark, folder))


def staged_rows(spark, folder):
    """Start counts with text measures, place type and mapped category."""
    mapped = mapping.map_codes(coded_texts(spark, folder), "ind", mapping.reciprocal(segment_relations(spark, folder)))
    places = B.geo_dim(spark, folder).select("geo", "geo_type")
    return mapped.join(places, "geo").select(
        *B.KEY, "target_code", "category_status",
        F.when(F.col("geo_type") == "MSA", "direct_match").otherwise("unresolved").alias("place_status"),
        "backbone_text", "starts_text",
        M.parse_measure(F.col("backbone_text")).alias("backbone"),
        M.parse_estimate(F.col("starts_text")).alias("starts"),
        M.any_code(["backbone_text", "starts_text"], M.SUPPRESSION_CODES).alias("is_suppressed"),
    ).withColumn("is_missing", M.any_null(["backbone", "starts"]))


_STAGED = (
    B.START_COUNTS_SQL + "," + _TEXTS + "," + B.GEO_SQL + "," + _RELATIONS
    + """,
staged AS (
  SELECT t.geo, t.ind, t.yr, target_code, category_status,
         CASE WHEN geo_type = 'MSA' THEN 'direct_match' ELSE 'unresolved' END AS place_status, backbone_text, starts_text,
         CASE WHEN t.backbone >= 12 AND t.backbone NOT IN (13, 14) THEN t.backbone + 0.5::DOUBLE END AS backbone,
         CASE WHEN t.starts >= 2 THEN (t.starts - 3)::DOUBLE END AS starts,
         t.backbone < 12 AS is_suppressed
  FROM texts t JOIN geo_dim g ON g.geo = t.geo LEFT JOIN accepted a ON a.source_code = t.ind),
staged_rows AS (SELECT *, (backbone IS NULL OR starts IS NULL) AS is_missing FROM staged)"""
)


@query(
    "staging_projection",
    f"WITH {_STAGED} SELECT geo, ind, yr, target_code, category_status, place_status, backbone_text, starts_text, backbone, starts, is_suppressed, is_missing FROM staged_rows",
)
def staging_projection(spark, folder):
    return staged_rows(spark, folder)


@query(
    "accepted_layer",
    f"""WITH {_STAGED} SELECT geo, target_code AS ind, yr, round(starts / backbone * 100, 6) AS rate, is_suppressed
        FROM staged_rows WHERE place_status = 'direct_match' AND category_status IN ('directly_comparable', 'official_mapping_required') AND NOT is_missing""",
)
def accepted_layer(spark, folder):
    """Only mapped, complete rows enter the accepted layer."""
    kept = staged_rows(spark, folder).filter(
        (F.col("place_status") == "direct_match")
        & F.col("category_status").isin("directly_comparable", "official_mapping_required")
        & ~F.col("is_missing")
    )
    return B.rounded(
        kept.select("geo", F.col("target_code").alias("ind"), "yr", M.percent_of(F.col("starts"), F.col("backbone")).alias("rate"), "is_suppressed")
    )


_REJECT_CASE = """CASE WHEN place_status <> 'direct_match' THEN 'unresolved_geography'
  WHEN category_status = 'unresolved' THEN 'unresolved_industry' WHEN is_suppressed THEN 'suppressed_value' WHEN is_missing THEN 'missing_required_startup_measure' END"""


def reject_reasons():
    return [
        (F.col("place_status") != "direct_match", "unresolved_geography"),
        (F.col("category_status") == "unresolved", "unresolved_industry"),
        (F.col("is_suppressed"), "suppressed_value"),
        (F.col("is_missing"), "missing_required_startup_measure"),
    ]


@query(
    "reject_reasons",
    f"""WITH {_STAGED} SELECT 'starts' AS stage, geo, ind, yr, {_REJECT_CASE} AS reason FROM staged_rows WHERE {_REJECT_CASE} IS NOT NULL""",
)
def reject_rows(spark, folder):
    return audit.rejects(staged_rows(spark, folder), "starts", B.KEY, reject_reasons()).drop("payload")


@query(
    "reject_summary",
    f"WITH {_STAGED} SELECT 'starts' AS stage, {_REJECT_CASE} AS reason, count(*) AS rejected_rows FROM staged_rows WHERE {_REJECT_CASE} IS NOT NULL GROUP BY 1, 2",
)
def reject_summary(spark, folder):
    return audit.reject_summary(audit.rejects(staged_rows(spark, folder), "starts", B.KEY, reject_reasons()))


@query(
    "missing_ratio_causes",
    f"""WITH {_STAGED}, causes AS (
          SELECT CAST(yr AS VARCHAR) AS yr, ind, CAST(is_suppressed AS VARCHAR) AS sup,
                 CASE WHEN place_status <> 'direct_match' THEN 'geography_mismatch'
                      WHEN category_status = 'unresolved' THEN 'industry_mismatch'
                      WHEN trim(backbone_text) IN ('D', 'S') THEN 'denominator_suppressed'
                      WHEN backbone IS NULL THEN 'denominator_missing' ELSE 'other' END AS cause
          FROM staged_rows WHERE backbone IS NULL OR starts IS NULL),
        counts AS (
          SELECT 'all' AS dimension, 'all' AS dimension_value, cause, count(*) AS row_count FROM causes GROUP BY cause
          UNION ALL SELECT 'year', yr, cause, count(*) FROM causes GROUP BY yr, cause
          UNION ALL SELECT 'category', ind, cause, count(*) FROM causes GROUP BY ind, cause
          UNION ALL SELECT 'suppressed', sup, cause, count(*) FROM causes GROUP BY sup, cause)
        SELECT *, round_even(100.0::DOUBLE * row_count / sum(row_count) OVER (PARTITION BY dimension, dimension_value), 2) AS pct FROM counts""",
)
def missing_ratio_causes(spark, folder):
    rows = staged_rows(spark, folder).filter("is_missing").withColumn(
        "cause",
        M.missing_ratio_reason(
            F.col("starts_text"), F.col("backbone_text"), F.col("place_status"), F.col("category_status")
        ),
    )
    counts = audit.counts_by_dimension(
        rows, {"year": F.col("yr"), "category": F.col("ind"), "suppressed": F.col("is_suppressed")}, "cause"
    )
    return audit.share_within(counts, ["dimension", "dimension_value"], "row_count", "pct")


@query(
    "union_mapping_audit",
    f"""WITH {_RELATIONS}, u AS (SELECT c_mktsegment AS code FROM customer UNION ALL SELECT c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
        k AS (SELECT code, count(*) AS n FROM u GROUP BY 1)
        SELECT coalesce(category_status, 'unresolved') AS category_status, count(*) AS code_count, CAST(sum(n) AS BIGINT) AS row_count
        FROM k LEFT JOIN accepted ON source_code = code GROUP BY 1""",
)
def union_mapping_audit(spark, folder):
    first = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("code"))
    second = B.orders_by_cell(spark, folder).select(F.col("ind").alias("code"))
    mapped = mapping.map_codes(first.unionByName(second), "code", mapping.reciprocal(segment_relations(spark, folder)))
    return audit.mapping_audit(mapped, "code", "category_status")


_STAGE_COLUMNS = """geo, ind, yr, members_expected, members_observed, members_suppressed, members_missing, source_rows,
  is_complete, establishments, employment, round(payroll, 2) AS payroll"""


@query("coverage_rollup", B.with_sql(B.SUPPORT_SQL) + f"SELECT {_STAGE_COLUMNS} FROM support_stage")
def coverage_rollup(spark, folder):
    return B.rounded(B.support_stage(spark, folder), 2)


@query(
    "coverage_rollup_complete",
    B.with_sql(B.SUPPORT_SQL)
    + """SELECT geo, ind, yr, employment, establishments, round_even(payroll / employment, 0) AS average_pay
         FROM support_stage WHERE is_complete""",
)
def coverage_rollup_complete(spark, folder):
    """Drop incomplete groups; average pay rounds half-even."""
    return B.support_stage(spark, folder).filter("is_complete").select(
        *B.KEY, "employment", "establishments", M.average_pay(F.col("payroll"), F.col("employment")).alias("average_pay")
    )


@query(
    "incomplete_groups",
    B.with_sql(B.SUPPORT_SQL)
    + """SELECT geo, count(*) AS incomplete_groups, CAST(sum(members_suppressed) AS BIGINT) AS suppressed_members
         FROM support_stage WHERE NOT is_complete GROUP BY 1""",
)
def incomplete_groups(spark, folder):
    return (
        B.support_stage(spark, folder).filter("NOT is_complete").groupBy("geo")
        .agg(F.count(F.lit(1)).alias("incomplete_groups"), F.sum("members_suppressed").alias("suppressed_members"))
    )


@query(
    "rollup_rejects",
    B.with_sql(B.SUPPORT_SQL)
    + """SELECT 'support' AS stage, geo, ind, yr, CASE WHEN members_suppressed > 0 THEN 'suppressed_value' WHEN members_missing > 0 THEN 'missing_required_measure'
         ELSE 'incomplete_aggregation' END AS reason FROM support_stage WHERE NOT is_complete""",
)
def rollup_rejects(spark, folder):
    return audit.rejects(B.support_stage(spark, folder), "support", B.KEY, audit.rollup_reasons()).drop("payload")


@query(
    "rollup_lineage",
    B.with_sql(B.SUPPORT_SQL) + "SELECT geo, ind, yr, member AS source_id FROM member_rows",
)
def rollup_lineage(spark, folder):
    return rollup.lineage(B.member_rows(spark, folder), B.KEY, "member")


@query(
    "control_pivot",
    B.with_sql(B.CONTROL_SQL)
    + f"""SELECT * REPLACE ({", ".join(f"round({c}, 6) AS {c}" for c in B.CONTROLS)}), CAST(5 AS BIGINT) AS source_rows, CAST(5 AS BIGINT) AS controls_present FROM control_layer""",
)
def control_pivot(spark, folder):
    return B.rounded(B.control_layer(spark, folder))


@query(
    "event_pivot",
    """SELECT user_id, CAST(ts AS DATE) AS day, """
    + ", ".join(
        f"max(value) FILTER (WHERE event_type = '{e}') AS {e}, max(CAST(json_extract_string(props, '$.k') AS INT)) FILTER (WHERE event_type = '{e}') AS {e}_k"
        for e in ("click", "view", "error")
    )
    + ", count(*) AS source_rows, count(DISTINCT event_type) AS controls_present FROM events GROUP BY 1, 2",
)
def event_pivot(spark, folder):
    """Long event rows with a JSON payload to one wide row per user and day."""
    rows = table(spark, folder, "events").select(
        "user_id", F.to_date("ts").alias("day"), "event_type", "value",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )
    return rollup.pivot_controls(rows, ["user_id", "day"], "event_type", ["click", "view", "error"], {"value": "", "k": "k"})


@query(
    "payload_selected_rows",
    """SELECT event_type, count(*) AS selected_rows, round(sum(value), 4) AS total FROM events
       WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50 GROUP BY 1""",
)
def payload_selected_rows(spark, folder):
    """Eligible rows chosen by a field that only the JSON payload holds."""
    eligible = F.get_json_object("props", "$.k").try_cast("int") >= 50
    return table(spark, folder, "events").filter(eligible).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("selected_rows"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "source_overlap",
    """WITH u AS (SELECT DISTINCT 'customers' AS s, CAST(c_nationkey AS VARCHAR) AS code FROM customer WHERE c_acctbal > 0
        UNION SELECT DISTINCT 'suppliers', CAST(s_nationkey AS VARCHAR) FROM supplier UNION SELECT DISTINCT 'nations', CAST(n_nationkey AS VARCHAR) FROM nation)
       SELECT code, count(*) AS source_count, string_agg(s, ',' ORDER BY s) AS sources, count(*) = 3 AS is_common FROM u GROUP BY 1""",
)
def source_overlap(spark, folder):
    def codes(name, column, keep="true"):
        return table(spark, folder, name).filter(keep).select(F.col(column).cast("string").alias("code"))

    return audit.source_overlap(
        {
            "customers": codes("customer", "c_nationkey", "c_acctbal > 0"),
            "suppliers": codes("supplier", "s_nationkey"),
            "nations": codes("nation", "n_nationkey"),
        },
        "code",
    )


@query(
    "common_codes",
    """SELECT CAST(c_nationkey AS VARCHAR) AS code FROM customer INTERSECT SELECT CAST(s_nationkey AS VARCHAR) FROM supplier
       INTERSECT SELECT CAST(n_nationkey AS VARCHAR) FROM nation""",
)
def common_codes(spark, folder):
    sources = {
        "customers": table(spark, folder, "customer").select(F.col("c_nationkey").cast("string").alias("code")),
        "suppliers": table(spark, folder, "supplier").select(F.col("s_nationkey").cast("string").alias("code")),
        "nations": table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("code")),
    }
    return audit.common_codes(audit.source_overlap(sources, "code"))


@query(
    "readiness_grid",
    """WITH y AS (SELECT CAST(range AS INT) AS yr FROM range(1993, 2004)),
       c AS (SELECT 'orders' AS source, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n FROM orders GROUP BY 2
             UNION ALL SELECT 'lines', CAST(year(l_shipdate) AS INT), count(*) FROM lineitem GROUP BY 2)
       SELECT s.source, y.yr, coalesce(n, 0) AS row_count, CASE WHEN n > 0 THEN 'ready' ELSE 'blocked' END AS state
       FROM (VALUES ('orders'), ('lines')) s(source) CROSS JOIN y LEFT JOIN c ON c.source = s.source AND c.yr = y.yr""",
)
def readiness_grid(spark, folder):
    sources = {
        "orders": table(spark, folder, "orders").select(B.year_of("o_orderdate")),
        "lines": table(spark, folder, "lineitem").select(B.year_of("l_shipdate")),
    }
    return audit.readiness_grid(sources, "yr", 1993, 2003)


@query(
    "vintage_audit",
    f"""WITH {_RELATIONS}, r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'BDS' WHEN o_orderstatus = 'O' THEN 'QCEW' ELSE 'CBP' END AS source,
          CAST(year(o_orderdate) + 15 AS INT) AS yr, CASE WHEN o_orderpriority = '1-URGENT' THEN '2012' ELSE '2017' END AS stored, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
        v AS (SELECT *, CASE WHEN source = 'BDS' THEN '2017' WHEN source = 'QCEW' THEN CASE WHEN yr = 2010 THEN '2007' ELSE '2012' END
              ELSE CASE WHEN yr <= 2011 THEN '2007' ELSE '2012' END END AS expected FROM r)
        SELECT source, yr, count(*) AS row_count, count(*) FILTER (WHERE category_status = 'directly_comparable') AS direct_rows,
          count(*) FILTER (WHERE category_status = 'official_mapping_required') AS mapped_rows,
          count(*) FILTER (WHERE category_status = 'unresolved') AS unresolved_rows,
          count(*) FILTER (WHERE stored <> expected) AS vintage_mismatches,
          coalesce(string_agg(DISTINCT target_code, ',' ORDER BY target_code), '') AS retained_codes,
          coalesce(string_agg(DISTINCT CASE WHEN target_code IS NULL THEN source_code END, ',' ORDER BY CASE WHEN target_code IS NULL THEN source_code END), '') AS excluded_codes
        FROM v JOIN accepted ON source_code = c_mktsegment GROUP BY 1, 2""",
)
def vintage_audit(spark, folder):
    status = F.col("o_orderstatus")
    rows = B.orders_by_cell(spark, folder).select(
        F.when(status == "F", "BDS").when(status == "O", "QCEW").otherwise("CBP").alias("source"),
        (F.year("o_orderdate") + 15).alias("yr"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "2012").otherwise("2017").alias("stored"),
        "ind",
    )
    mapped = mapping.map_codes(rows, "ind", mapping.reciprocal(segment_relations(spark, folder)))
    return audit.vintage_audit(
        mapped, "source", "yr", "ind", "target_code", "stored", C.vintage_of(F.col("source"), F.col("yr")), "category_status"
    )


@query(
    "stage_quality_metrics",
    f"""WITH {_STAGED}, m AS (SELECT yr, count(*)::DOUBLE AS staged_rows, count(*) FILTER (WHERE is_suppressed)::DOUBLE AS suppressed_rows,
          count(*) FILTER (WHERE is_missing)::DOUBLE AS missing_rows, count(DISTINCT geo)::DOUBLE AS places FROM staged_rows GROUP BY 1)
        SELECT 'stg_starts' AS table_name, metric, value, 'national' AS scope, yr FROM m
        UNPIVOT (value FOR metric IN (staged_rows, suppressed_rows, missing_rows, places))""",
)
def stage_quality_metrics(spark, folder):
    return audit.metrics(
        staged_rows(spark, folder),
        "stg_starts",
        {
            "staged_rows": F.count(F.lit(1)),
            "suppressed_rows": F.count_if(F.col("is_suppressed")),
            "missing_rows": F.count_if(F.col("is_missing")),
            "places": F.count_distinct("geo"),
        },
        by=["yr"],
        scope="national",
    )
