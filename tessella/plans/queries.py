"""The library's operators as named queries over the benchmark tables, each with the SQL that it must equal.

The SQL states results in its own way (long tables, joins to VALUES) rather than repeating the expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text, udfs, units
from tessella.operators import attributes, catalogue, classify, content, delivery, discovery, metrics, resolve, retrieval, review, validate
from tessella.plans import oracles, standin
from tessella.plans.enrich import References, enrich
from tessella.sources import providers, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAN = lambda c: f"CASE WHEN lower(trim({c})) NOT IN {oracles.PLACEHOLDERS} THEN trim({c}) END"
_CLEANED_SQL = f"cln AS (SELECT p_partkey, row_id, {_CLEAN('Mfg_Part_Num')} AS mpn, {_CLEAN('Part_Desc')} AS part_desc, {_CLEAN('E1_Brand')} AS e1_brand, {_CLEAN('Unilog_Brand')} AS unilog_brand, {_CLEAN('DIB_Brand')} AS dib_brand, {_CLEAN('Part_Manuf')} AS part_manuf FROM cat)"
_WITH = f"WITH {standin.CATALOGUE_SQL}, {_CLEANED_SQL} "
_MASTER_SQL = "master AS (SELECT p_brand AS name, concat('B-', split_part(p_brand, '#', 2)) AS code, min(p_partkey) AS ordinal FROM part GROUP BY p_brand)"
_UNITS_SQL = oracles.UNITS
_VALUES_SQL = oracles.VALUES
#: Fractions of an inch for a column n of numbers.
_FRACTION = lambda n: f"""(CASE WHEN round_even(({n} - floor({n})) * 64, 0) IN (0, 64) THEN CAST(CAST(floor({n}) + CASE WHEN round_even(({n} - floor({n})) * 64, 0) = 64 THEN 1 ELSE 0 END AS BIGINT) AS VARCHAR)
  ELSE (CASE WHEN floor({n}) = 0 THEN '' ELSE CAST(CAST(floor({n}) AS BIGINT) AS VARCHAR) || '-' END) ||
    CAST(CAST(round_even(({n} - floor({n})) * 64, 0) AS INT) // gcd(CAST(round_even(({n} - floor({n})) * 64, 0) AS INT), 64) AS VARCHAR) || '/' || CAST(64 // gcd(CAST(round_even(({n} - floor({n})) * 64, 0) AS INT), 64) AS VARCHAR) END)"""  # noqa: E731
_ATTR_SQL = f"""{standin.ATTRIBUTES_SQL}, attr0 AS (
  SELECT p_partkey, pos, label, nullif(trim(candidate_value), '') AS raw_value, nullif(trim(candidate_uom), '') AS raw_uom, candidate_uom, source, source_page, CASE WHEN coalesce(confidence, 0) = 0 THEN 0.5 ELSE confidence END AS confidence,
    (SELECT uom FROM {_UNITS_SQL} WHERE spelling = lower(trim(candidate_uom))) AS known, (SELECT canonical FROM {_VALUES_SQL} WHERE spelling = lower(trim(candidate_value))) AS canonical, lower(label) NOT IN {oracles.CONTROLLED_LABELS} AS free FROM cand),
attr AS (SELECT p_partkey, pos, label,
    CASE WHEN raw_value IS NULL THEN NULL WHEN known = 'in' AND try_cast(raw_value AS DOUBLE) IS NOT NULL THEN {_FRACTION("try_cast(raw_value AS DOUBLE)")} WHEN free OR canonical IS NULL THEN raw_value ELSE canonical END AS value,
    CASE WHEN raw_value IS NULL THEN nullif(candidate_uom, '') ELSE coalesce(known, raw_uom) END AS uom, raw_value, source, source_page, confidence,
    raw_value IS NOT NULL AND (free OR canonical IS NOT NULL) AS lov_matched,
    raw_value IS NOT NULL AND (NOT (free OR canonical IS NOT NULL) OR confidence < 0.7 OR (raw_uom IS NOT NULL AND known IS NULL)) AS needs_review FROM attr0)"""


def _cleaned(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return catalogue.cleaned(standin.catalogue(standin.part(spark, sf_dir), *extra))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with attributes and what texts need."""
    p = standin.part(spark, sf_dir)
    base = p.select("p_partkey", attributes.normalise_all(standin.candidates()).alias("attributes"), F.expr("concat('Maker ', cast(p_partkey % 76 AS string))").alias("manufacturer_name"), F.concat("p_brand", F.lit("®")).alias("brand_name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("mpn"), F.lit(None).cast("string").alias("product_name"), F.concat(F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("s")).alias("fine"), F.lit("Hardware").alias("class_name"), F.lit("Goods").alias("dept"), F.expr("CASE p_partkey % 10 WHEN 0 THEN 'Spare Key' END").alias("with_value"), F.expr("CASE p_partkey % 8 WHEN 0 THEN array('First', 'first ', 'Made well') ELSE array() END").cast("array<string>").alias("features"))
    return base


_PART_SQL = """p0 AS (SELECT p_partkey, concat('Maker ', CAST(p_partkey % 76 AS VARCHAR)) AS manufacturer, p_brand || '®' AS brand, p_brand AS plain, 'P' || CAST(p_partkey AS VARCHAR) AS mpn, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS kind,
  CASE WHEN p_partkey % 10 = 0 THEN 'Spare Key' END AS w, CASE WHEN p_partkey % 8 = 0 THEN ['First', 'Made well'] ELSE [] END AS feats FROM part)"""


def _pivot(*names: tuple[str, str, str]) -> str:
    return "av AS (SELECT p_partkey, " + ", ".join(f"max(CASE WHEN label = '{label}' THEN {what} END) AS {alias}" for alias, label, what in names) + " FROM attr GROUP BY p_partkey)"


_WHOLE = "CASE WHEN try_cast({0} AS DOUBLE) = floor(try_cast({0} AS DOUBLE)) THEN CAST(CAST(try_cast({0} AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE {0} END"
_CONTENT_SQL = f"""WITH {_ATTR_SQL}, {_PART_SQL}, {_pivot(("mount", "Mounting Type", "value"), ("cyc", "Number of Wash Cycles", "value"), ("mat", "Material", "value"), ("volt", "Voltage Rating", "value"), ("amp", "Amperage Rating", "value"), ("amp_uom", "Amperage Rating", "uom"), ("sound", "Sound Level", "value"), ("color", "Color", "value"), ("size", "Size", "value"))},
x AS (SELECT p0.*, av.* EXCLUDE (p_partkey, cyc), {_WHOLE.format("cyc")} AS cyc, volt || ' V' AS volts, amp || ' ' || amp_uom AS amps, sound || ' dBA' AS sounds,
  CASE WHEN lower(mat) LIKE '%stainless steel%' THEN 'SST' WHEN lower(mat) LIKE '%brass%' THEN 'BRS' WHEN lower(mat) LIKE '%aluminum%' THEN 'ALUM' ELSE upper(mat) END AS short_mat FROM p0 JOIN av USING (p_partkey)) """


# -- Cleaning, keys, headers -----------------------------------------------------------------------------------------
@query(_WITH + "SELECT row_id, mpn, part_desc, e1_brand, unilog_brand, dib_brand, part_manuf FROM cln")
def clean_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("row_id", "mpn", "part_desc", "e1_brand", "unilog_brand", "dib_brand", "part_manuf")


@query(_WITH + "SELECT row_id, coalesce(unilog_brand, e1_brand, dib_brand) AS best_brand, coalesce(part_manuf, unilog_brand, e1_brand, dib_brand) AS best_manufacturer, coalesce(unilog_brand, e1_brand, dib_brand) IS NOT NULL AS has_brand FROM cln")
def best_brand_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("row_id", "best_brand", "best_manufacturer", "has_brand")


@query(_WITH + "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN row_id END, mpn, part_desc, 'row') AS key FROM cln")
def product_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "p_partkey").select("p_partkey", catalogue.product_key(F.when(F.col("p_partkey") % 2 == 0, F.col("row_id")), F.col("mpn"), F.col("part_desc")).alias("key"))


@query("SELECT 'ACME Part Number' AS header, 'Mfg_Part_Num' AS canonical UNION ALL SELECT 'Primary Description (EN)', 'Part_Desc' UNION ALL SELECT 'Manufacturer Name', 'Part_Manuf' UNION ALL SELECT 'E1 Brand Code', 'E1_Brand'")
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogue.map_headers(["ACME Part Number", "Primary Description (EN)", "Manufacturer Name", "E1 Brand Code", "Extra Notes"])
    return spark.createDataFrame([(h, c) for c, h in found.mapped.items()], "header string, canonical string")


@query("SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower('  ' || s_name || '/Co. & Sons '), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM supplier")
def entity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select("s_suppkey", text.entity_key(F.concat(F.lit("  "), "s_name", F.lit("/Co. & Sons "))).alias("key"))


@query(_WITH + "SELECT p_partkey, CASE WHEN regexp_matches(part_manuf, '\\([^()]+\\)$') THEN trim(regexp_extract(part_manuf, '^(.*)\\(', 1)) ELSE part_manuf END AS name, nullif(regexp_extract(part_manuf, '\\(([^()]+)\\)$', 1), '') AS code FROM cln WHERE part_manuf IS NOT NULL")
def name_code_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, code = catalogue.name_and_code(F.col("part_manuf"))
    return _cleaned(spark, sf_dir, "p_partkey").where("part_manuf IS NOT NULL").select("p_partkey", name.alias("name"), code.alias("code"))


@query(_WITH + "SELECT name, coalesce(code, 'MFR-' || lpad(CAST(row_number() OVER (ORDER BY name) AS VARCHAR), 4, '0')) AS code FROM (SELECT name, min(code) AS code FROM (SELECT CASE WHEN part_manuf LIKE '%(%' THEN trim(regexp_extract(part_manuf, '^(.*)\\(', 1)) ELSE part_manuf END AS name, nullif(regexp_extract(part_manuf, '\\(([^()]+)\\)$', 1), '') AS code FROM cln WHERE part_manuf IS NOT NULL UNION ALL SELECT p_brand, NULL FROM part) GROUP BY name)")
def bootstrap_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.bootstrap_master(_cleaned(spark, sf_dir).select(F.col("part_manuf").alias("raw")), standin.part(spark, sf_dir).select(F.col("p_brand").alias("raw")))


@query(f"WITH {standin.CATALOGUE_SQL}" + " SELECT p_partkey, trim(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' 3/8 Coupling Brass 150 lb' WHEN 1 THEN ' Schedule 40 Valve Stainless Steel' WHEN 2 THEN ' Standard Hex' ELSE '' END AS expanded FROM (SELECT p_partkey, regexp_replace(p_name, '\\bred\\b', 'Reducer') AS p_name FROM cat)")
def abbreviation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.catalogue(standin.part(spark, sf_dir), "p_partkey").select("p_partkey", text.expand_abbreviations("Part_Desc").alias("expanded"))


# -- Resolution ------------------------------------------------------------------------------------------------------
_RAW_BRANDS = ("CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN upper(replace(p_brand, '#', '  ')) WHEN 2 THEN concat('-', p_brand, '.') WHEN 3 THEN concat(p_brand, ' Company of Nowhere') WHEN 4 THEN concat('The ', p_brand, ' Co.') WHEN 5 THEN replace(p_brand, 'rand#', 'rnad ') ELSE concat(' ', p_brand, '0 ') END")
_RAW_SQL = "raws AS (SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN upper(replace(p_brand, '#', '  ')) WHEN 2 THEN concat('-', p_brand, '.') WHEN 3 THEN concat(p_brand, ' Company of Nowhere') WHEN 4 THEN concat('The ', p_brand, ' Co.') WHEN 5 THEN replace(p_brand, 'rand#', 'rnad ') ELSE concat(' ', p_brand, '0 ') END AS raw FROM part)"
_KEY = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.part(spark, sf_dir).select(F.expr(_RAW_BRANDS).alias("raw")).distinct()


@query(f"WITH {_RAW_SQL}, {_MASTER_SQL} SELECT raw, name, code, CASE WHEN name IS NOT NULL THEN 1.0::DOUBLE END AS confidence, CASE WHEN name IS NOT NULL THEN 'exact' END AS method FROM raws LEFT JOIN master ON raw = name")
def resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.exact(_raw(spark, sf_dir), standin.master(standin.part(spark, sf_dir)))


@query(f"WITH {_RAW_SQL}, {_MASTER_SQL} SELECT raw, name, code, CASE WHEN name IS NOT NULL THEN 0.97::DOUBLE END AS confidence, CASE WHEN name IS NOT NULL THEN 'normalized' END AS method FROM raws LEFT JOIN (SELECT {_KEY('name')} AS k, arg_min(name, ordinal) AS name, arg_min(code, ordinal) AS code FROM master GROUP BY 1) m ON m.k = {_KEY('raw')}")
def resolve_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.normalised(_raw(spark, sf_dir), standin.master(standin.part(spark, sf_dir)))


#: Matching-blocks similarity of pairs(id, a, b), by recursion: the longest run that a range of a and one of b share, the first of equals, then what is left and right of it.
_RATIO_SQL = """pos AS MATERIALIZED (SELECT id, i, j, coalesce(list_min(list_filter(range(0, least(length(a) - i, length(b) - j)), lambda k: a[i + k + 1] <> b[j + k + 1])), least(length(a) - i, length(b) - j)) AS run
    FROM pairs, unnest(range(0, length(a))) AS t(i), unnest(range(0, length(b))) AS u(j) WHERE a[i + 1] = b[j + 1]),
blocks(id, alo, ahi, blo, bhi, n) AS (SELECT id, 0::BIGINT, length(a), 0::BIGINT, length(b), 0::BIGINT FROM pairs UNION ALL
  SELECT s.id, x.alo, x.ahi, x.blo, x.bhi, CASE WHEN x.k = 0 THEN s.size ELSE 0 END FROM (
    SELECT g.id, alo, ahi, blo, bhi, max(least(run, ahi - i, bhi - j)) AS size, arg_max({'i': i, 'j': j}, least(run, ahi - i, bhi - j) * 1000000 - i * 1000 - j) AS at
    FROM blocks g JOIN pos ON pos.id = g.id AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY ALL) s,
    LATERAL (SELECT * FROM (VALUES (0, s.alo, s.at.i, s.blo, s.at.j), (1, s.at.i + s.size, s.ahi, s.at.j + s.size, s.bhi)) AS v(k, alo, ahi, blo, bhi)) x),
ratios AS (SELECT id, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * sum(n) / (length(a) + length(b)) END AS score FROM blocks JOIN pairs USING (id) GROUP BY id, a, b)"""


def _fuzzy_sql(raws: str, floor: float) -> str:
    """near(raw, name, code, confidence): the most similar key of master for each of raws(raw)."""
    return f"""pairs AS (SELECT row_number() OVER () AS id, raw, name, code, ordinal, {_KEY("raw")} AS a, {_KEY("name")} AS b FROM (SELECT DISTINCT raw FROM {raws}), master), {_RATIO_SQL},
near AS (SELECT raw, name, code, round(score, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, ordinal) AS r FROM pairs JOIN ratios USING (id)) WHERE r = 1 AND score >= {floor})"""


@query(f"WITH RECURSIVE {_RAW_SQL}, {_MASTER_SQL}, {_fuzzy_sql('raws', 0.70)} SELECT raw, name, code, confidence, 'fuzzy' AS method FROM near")
def resolve_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.fuzzy(_raw(spark, sf_dir), standin.master(standin.part(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_RAW_SQL}, {_MASTER_SQL}, trimmed AS (SELECT raw AS whole, trim(raw) AS raw FROM raws), {_fuzzy_sql('trimmed', 0.70)},
keyed AS (SELECT {_KEY("name")} AS k, arg_min(name, ordinal) AS name, arg_min(code, ordinal) AS code FROM master GROUP BY 1),
found AS (SELECT whole, CASE WHEN e.name IS NOT NULL THEN [e.name, e.code, '1.0', 'exact'] WHEN k.name IS NOT NULL THEN [k.name, k.code, '0.97', 'normalized'] WHEN near.name IS NOT NULL THEN [near.name, near.code, CAST(near.confidence AS VARCHAR), 'fuzzy'] ELSE [NULL, NULL, '0.0', 'unresolved'] END AS f
  FROM trimmed t LEFT JOIN master e ON e.name = t.raw LEFT JOIN keyed k ON k.k = {_KEY("t.raw")} LEFT JOIN near ON near.raw = t.raw)
SELECT p_partkey, raw, f[1] AS name, f[2] AS code, CAST(f[3] AS DOUBLE) AS confidence, f[4] AS method, CAST(f[3] AS DOUBLE) < 0.82 AS needs_review FROM (SELECT p_partkey, {_RAW_BRANDS} AS raw FROM part) p JOIN found ON whole = raw""")
def resolve_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.resolve(standin.part(spark, sf_dir).select("p_partkey", F.expr(_RAW_BRANDS).alias("raw")), "raw", standin.master(standin.part(spark, sf_dir)))
    return out.select("p_partkey", "raw", "raw_match.*")


# -- Classification --------------------------------------------------------------------------------------------------
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.catalogue(standin.part(spark, sf_dir)).select(F.lower("Part_Desc").alias("text")).distinct()


@query(f"WITH {standin.CATALOGUE_SQL}, {standin.TAXONOMY_SQL}, t AS (SELECT DISTINCT lower(Part_Desc) AS text FROM cat), h AS (SELECT text, tax.*, len(list_filter(keywords, lambda k: contains(text, k))) AS hits FROM t, tax), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY hits DESC, ordinal) AS k FROM h WHERE hits > 0) SELECT text, dept, class_name, fine, CAST(least(0.95, 0.5 + 0.15 * hits) AS DOUBLE) AS confidence, 'keyword' AS method FROM r WHERE k = 1")
def taxonomy_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.by_keywords(_texts(spark, sf_dir), standin.taxonomy(spark))


_KEYWORD_SQL = "h AS (SELECT text, tax.*, len(list_filter(keywords, lambda k: contains(text, k))) AS hits FROM t, tax), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY hits DESC, ordinal) AS k FROM h WHERE hits > 0), keyed AS (SELECT text, dept, class_name, fine, CAST(least(0.95, 0.5 + 0.15 * hits) AS DOUBLE) AS confidence, 'keyword' AS method FROM r WHERE k = 1)"
_LIKE_SQL = f"pairs AS (SELECT row_number() OVER () AS id, text, tax.* EXCLUDE (keywords), text AS a, lower(concat_ws(' ', fine, class_name, dept)) || ' ' || array_to_string(keywords, ' ') AS b FROM rest, tax), {_RATIO_SQL}, liked AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, ordinal) AS rank FROM pairs JOIN ratios USING (id))"


@query(f"WITH RECURSIVE {standin.CATALOGUE_SQL}, {standin.TAXONOMY_SQL}, rest AS (SELECT DISTINCT lower(Part_Desc) AS text FROM cat), {_LIKE_SQL} SELECT text, CAST(rank AS INTEGER) AS rank, dept, class_name, fine, round(score, 4) AS confidence, 'fuzzy' AS method FROM liked WHERE rank <= 5 AND score >= 0.1")
def taxonomy_fuzzy_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.by_similarity(_texts(spark, sf_dir), standin.taxonomy(spark), 5, 0.1)


@query(f"""WITH RECURSIVE {standin.CATALOGUE_SQL}, {standin.TAXONOMY_SQL}, t AS (SELECT DISTINCT lower(Part_Desc) AS text FROM cat), {_KEYWORD_SQL}, rest AS (SELECT text FROM t WHERE text NOT IN (SELECT text FROM keyed)), {_LIKE_SQL},
every AS (SELECT * FROM keyed UNION ALL SELECT text, dept, class_name, fine, round(score, 4), 'fuzzy' FROM liked WHERE rank = 1 AND score >= 0.3)
SELECT p_partkey, dept, class_name, fine, dept || '>' || class_name || '>' || fine AS classpath, coalesce(confidence, 0.0::DOUBLE) AS confidence, coalesce(method, 'unresolved') AS method, coalesce(confidence, 0.0::DOUBLE) < 0.6 AS needs_review FROM cat LEFT JOIN every ON text = lower(Part_Desc)""")
def classify_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.classify(standin.catalogue(standin.part(spark, sf_dir), "p_partkey").withColumn("text", F.lower("Part_Desc")), "text", standin.taxonomy(spark))
    return out.select("p_partkey", "classification.*")


@query(f"WITH {standin.TAXONOMY_SQL} SELECT concat_ws('>', dept, class_name, fine) AS path, dept AS d, class_name AS c, fine AS f FROM tax")
def classpath_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = standin.taxonomy(spark).select(classify.class_path(F.col("dept"), F.col("class_name"), F.col("fine")).alias("path"))
    d, c, f = classify.split_path(F.col("path"))
    return paths.select("path", d.alias("d"), c.alias("c"), f.alias("f"))


# -- Discovery -------------------------------------------------------------------------------------------------------
@query(_WITH + """, q AS (SELECT p_partkey, coalesce(mpn, '') AS m, coalesce(part_manuf, '') AS f, coalesce(part_desc, '') AS d FROM cln)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN m <> '' AND f <> '' THEN f || ' ' || m || ' specifications' END, CASE WHEN m <> '' AND f <> '' THEN f || ' ' || m || ' datasheet' END, CASE WHEN m <> '' AND f <> '' THEN f || ' ' || m || ' installation manual' END, CASE WHEN m <> '' AND f <> '' THEN f || ' ' || m || ' technical data' END,
  CASE WHEN m <> '' THEN m || ' specifications' END, CASE WHEN m <> '' THEN m || ' datasheet' END, CASE WHEN m <> '' THEN m || ' Things' END, CASE WHEN f <> '' THEN f || ' Things specifications' END, CASE WHEN d <> '' THEN d END], lambda x: x IS NOT NULL), ' / ') AS queries FROM q""")
def query_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "p_partkey").select("p_partkey", F.array_join(discovery.search_queries(F.col("mpn"), F.col("part_manuf"), F.col("part_desc"), F.lit("Things")), " / ").alias("queries"))


@query(f"SELECT page_id, len(list_filter({oracles.BLOCKED_SITES}, lambda s: contains(lower(u), s))) > 0 AS blocked, regexp_replace(regexp_replace(u, '^https?://', '', 'i'), '/$', '') AS short FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.Rebuilders.com/' WHEN 1 THEN 'http://x.ebay.com/a/' ELSE url END AS u FROM pages)")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.expr("CASE page_id % 5 WHEN 0 THEN 'https://www.Rebuilders.com/' WHEN 1 THEN 'http://x.ebay.com/a/' ELSE url END")
    return _read(spark, sf_dir, "pages").select("page_id", discovery.blocked(u).alias("blocked"), text.short_url(u).alias("short"))


@query("""WITH l AS (SELECT conv_id, turn, i, trim(regexp_replace(trim(x), '^[-*•0-9.]+\\s*', '')) AS x FROM (SELECT conv_id, turn, unnest(range(0, 4)) AS i, unnest(['- http://a.example/' || conv_id || ' | Specification Sheet', '2. https://b.example', 'see nothing', 'http://c.example | odd kind']) AS x FROM conversations WHERE role = 'assistant'))
SELECT conv_id, turn, trim(split_part(x, '|', 1)) AS url, CASE WHEN contains(x, '|') AND replace(lower(trim(split_part(x, '|', 2))), ' ', '_') IN ('product_page', 'specification_sheet', 'installation_manual', 'catalogue', 'technical_doc') THEN replace(lower(trim(split_part(x, '|', 2))), ' ', '_') ELSE 'product_page' END AS document_type FROM l WHERE x LIKE 'http%'""")
def llm_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("- http://a.example/"), F.col("conv_id").cast("string"), F.lit(" | Specification Sheet\n2. https://b.example\nsee nothing\n\nhttp://c.example | odd kind"))
    return _read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.inline(discovery.parse_source_lines(reply)))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", udfs.html_text("html").alias("text"))


@query()
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    sources = pages.select("page_id", F.expr("CASE page_id % 4 WHEN 0 THEN concat(url, '.pdf') WHEN 1 THEN concat(url, '&gone') ELSE url END").alias("url"))
    return providers.fetched(sources, pages).select("page_id", "status", F.length("text").alias("chars"))


# -- Retrieval -------------------------------------------------------------------------------------------------------
_CHUNKS = """wd AS MATERIALIZED (SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w FROM documents),
ch AS MATERIALIZED (SELECT doc_id, source, i // 450 AS page, array_to_string(list_slice(w, i + 1, i + 500), ' ') AS chunk FROM wd, unnest(range(0, len(w), 450)) AS r(i))"""
#: ASCII words, so that both engines agree.
_TOKENS = "regexp_extract_all(lower(chunk), '[a-z0-9_]+')"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunked(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def _ascii(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " ")


@query(f"WITH {_CHUNKS} SELECT doc_id, page, len(string_split(chunk, ' ')) AS n, md5(chunk) AS digest FROM ch")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", F.col("page").cast("long").alias("page"), F.size(F.split("chunk", " ")).cast("long").alias("n"), F.md5("chunk").alias("digest"))


@query(f"WITH {_CHUNKS} SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS documents, CAST(max(page) AS BIGINT) AS last_page FROM ch GROUP BY source")
def chunk_count_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.max("page").cast("long").alias("last_page"))


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(page AS BIGINT) AS page, token, count(*) AS tf FROM (SELECT doc_id, page, unnest({_TOKENS}) AS token FROM ch) GROUP BY ALL")
def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).withColumn("chunk", _ascii("chunk"))
    return retrieval.term_frequencies(rows, ["doc_id", "page"]).select("doc_id", F.col("page").cast("long").alias("page"), "token", "tf")


@query(f"WITH {_CHUNKS} SELECT source, token, count(*) AS df FROM (SELECT source, doc_id, page, unnest(list_distinct({_TOKENS})) AS token FROM ch) GROUP BY source, token")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_frequencies(_chunks(spark, sf_dir).withColumn("chunk", _ascii("chunk")), ["source"])


_BM25 = f"""{_CHUNKS}, tk AS MATERIALIZED (SELECT source, doc_id, page, {_TOKENS} AS t FROM ch), st AS (SELECT source, count(*) AS n, avg(len(t)) AS a FROM tk GROUP BY source),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM benchmark), qt AS (SELECT query_id, token, count(*) AS times FROM q GROUP BY ALL),
tf AS (SELECT source, doc_id, page, token, count(*) AS tf, any_value(l) AS l FROM (SELECT source, doc_id, page, len(t) AS l, unnest(t) AS token FROM tk) WHERE token IN (SELECT token FROM qt) GROUP BY source, doc_id, page, token),
df AS (SELECT source, token, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT tf.source, query_id, doc_id, page, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a)) * times) AS score FROM tf JOIN df USING (source, token) JOIN st USING (source) JOIN qt USING (token) GROUP BY ALL),
rk AS (SELECT source, query_id, doc_id, CAST(page AS BIGINT) AS page, round(score, 4) AS score, row_number() OVER (PARTITION BY source, query_id ORDER BY round(score, 4) DESC, doc_id, page) AS rank FROM sc WHERE score > 0)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), _ascii("text").alias("query"))
    return retrieval.bm25(_chunks(spark, sf_dir).withColumn("chunk", _ascii("chunk")), asked, ["source"], ["doc_id", "page"], 3)


@query(f"WITH {_BM25} SELECT source, query_id, doc_id, page, score, rank FROM rk WHERE rank <= 3")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("source", "query_id", "doc_id", F.col("page").cast("long").alias("page"), "score", "rank")


@query(f"WITH {_BM25}, b AS (SELECT source, doc_id, page, round(max(score), 1) AS best_score, min({{'q': query_id, 'r': rank}}) AS seen, count(*) AS queries FROM rk WHERE rank <= 3 GROUP BY source, doc_id, page) SELECT source, doc_id, page, best_score, queries, row_number() OVER (PARTITION BY source ORDER BY best_score DESC, seen, doc_id, page) AS place FROM b")
def bm25_multi_query_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.evidence(_hits(spark, sf_dir), ["source"], ["doc_id", "page"], 1)
    return out.select("source", "doc_id", F.col("page").cast("long").alias("page"), "best_score", "queries", "place")


@query("SELECT doc_id, left(text, 400) AS snippet, CASE WHEN length(text) > 320 THEN left(text, 320) || '…' ELSE text END AS shown FROM documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.snippet("text").alias("snippet"), text.display_snippet("text").alias("shown"))


@query("SELECT doc_id, md5(regexp_replace(text, '(erat|the|on)', '<mark>\\1</mark>', 'gi')) AS digest FROM documents")
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.highlight(F.col("text"), ["on", "erat", "x", "the"])).alias("digest"))


# -- Units and values ------------------------------------------------------------------------------------------------
@query(f"SELECT p_partkey, uom FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' Inches ' WHEN 1 THEN 'AMPS' WHEN 2 THEN 'dba' WHEN 3 THEN 'xyz' WHEN 4 THEN '' END AS s FROM part) LEFT JOIN {_UNITS_SQL} ON spelling = lower(trim(s))")
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.part(spark, sf_dir).select("p_partkey", units.unit(F.expr("CASE p_partkey % 6 WHEN 0 THEN ' Inches ' WHEN 1 THEN 'AMPS' WHEN 2 THEN 'dba' WHEN 3 THEN 'xyz' WHEN 4 THEN '' END")).alias("uom"))


_MEASURES = "CASE p_partkey % 6 WHEN 0 THEN concat(cast(p_size AS string), ' inches') WHEN 1 THEN concat('  ', cast(p_size AS string), '.5   V ') WHEN 2 THEN cast(p_size AS string) WHEN 3 THEN 'volts' WHEN 4 THEN '50-1/4 in' ELSE '99 xyz' END"


@query(f"SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size WHEN 5 THEN 99 END AS DOUBLE) AS n, CASE p_partkey % 6 WHEN 0 THEN 'inches' WHEN 1 THEN 'V' WHEN 3 THEN 'volts' WHEN 4 THEN 'in' WHEN 5 THEN 'xyz' END AS unit FROM part")
def measurement_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rest = units.measurement(F.expr(_MEASURES))
    return standin.part(spark, sf_dir).select("p_partkey", n.alias("n"), rest.alias("unit"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || ' in' WHEN 1 THEN p_size || '.5 V' END AS standard, CASE p_partkey % 6 WHEN 0 THEN p_size || 'IN' WHEN 1 THEN p_size || '.5V' END AS compressed FROM part")
def measurement_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr(_MEASURES)
    return standin.part(spark, sf_dir).select("p_partkey", units.normal_measurement(m).alias("standard"), units.normal_measurement(m, True, True).alias("compressed"))


@query(f"SELECT event_id, CASE WHEN value >= 0 THEN {_FRACTION('value')} END AS fraction FROM events")
def decimal_to_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", units.to_fraction(F.col("value")).alias("fraction"))


@query("SELECT event_id, CASE WHEN value >= 0 THEN round_even(value * 64, 0) / 64 END AS number FROM events")
def fraction_to_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", units.from_fraction(units.to_fraction(F.col("value"))).alias("number"))


@query(f"WITH {_ATTR_SQL} SELECT p_partkey, label, value, uom, raw_value, source, source_page, confidence, lov_matched, needs_review FROM attr")
def normalize_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.part(spark, sf_dir).select("p_partkey", F.inline(attributes.normalise_all(standin.candidates())))


@query(f"WITH {_ATTR_SQL} SELECT p_partkey, max(CASE WHEN label = 'Voltage Rating' THEN value || ' V' END) AS volts, max(CASE WHEN label = 'Color' THEN value END) AS color, max(CASE WHEN label = 'Number of Wash Cycles' THEN value END) AS cycles FROM attr GROUP BY p_partkey")
def attribute_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attributes")
    return _products(spark, sf_dir).select("p_partkey", attributes.value_with_unit(a, "Voltage").alias("volts"), attributes.value_of(a, "Finish", "Color").alias("color"), attributes.value_of(a, "Wash Cycles").alias("cycles"))


@query(f"WITH {_ATTR_SQL} SELECT p_partkey, label, CASE WHEN needs_review THEN 'needs review' WHEN value IS NULL THEN 'empty (OK)' ELSE (CASE WHEN source LIKE 'http%' THEN 'grounded' WHEN coalesce(source, '') <> '' THEN 'desc only' ELSE 'no source' END) || CASE WHEN lov_matched THEN ' / LOV' ELSE ' / no LOV' END END AS status FROM attr")
def attr_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir).select("p_partkey", F.explode("attributes").alias("a")).select("p_partkey", "a.label", attributes.status(F.col("a")).alias("status"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, 1 AS others FROM events")
def json_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ', "color": "red", "gone": null}'), F.lit("\n```"))
    known, rest = attributes.facts(reply, ["k", "voltage"])
    return _read(spark, sf_dir, "events").select("event_id", F.try_element_at(known, F.lit("k")).alias("k"), F.size(rest).alias("others"))


@query("SELECT event_id, event_type AS label, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, 0.25::DOUBLE AS confidence FROM events")
def json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    reply = F.concat(F.lit('[{"label": "'), "event_type", F.lit('", "candidate_value": "'), k, F.lit('", "confidence": 0.25}, {"label": "", "candidate_value": "x"}, {"label": "y"}]'))
    return _read(spark, sf_dir, "events").select("event_id", F.inline(attributes.from_json(reply))).select("event_id", "label", F.col("candidate_value").alias("value"), "confidence")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || ' - ' || (p_size + 1) ELSE 'size ' || p_size END AS value, CASE p_partkey % 3 WHEN 0 THEN 'mm' WHEN 1 THEN 'A' END AS uom FROM part")
def value_uom_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, uom = attributes.split_value_unit(F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(cast(p_size AS string), 'mm.') WHEN 1 THEN concat(' ', cast(p_size AS string), ' - ', cast(p_size + 1 AS string), ' A ') ELSE concat('size ', cast(p_size AS string)) END"))
    return standin.part(spark, sf_dir).select("p_partkey", value.alias("value"), uom.alias("uom"))


@query("""SELECT p_partkey, label, candidate_value, candidate_uom, CAST(0.35 AS DOUBLE) AS confidence, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS INTEGER) AS place FROM (
  SELECT p_partkey, 1 AS k, 'Material' AS label, p_brand AS candidate_value, NULL AS candidate_uom FROM part WHERE p_partkey % 3 > 0
  UNION ALL SELECT p_partkey, 2, 'Size', CAST(p_size AS VARCHAR), 'mm' FROM part
  UNION ALL SELECT p_partkey, 3, 'Voltage', '2.8-4', 'V' FROM part
  UNION ALL SELECT p_partkey, 4, 'Terminal Kind', p_type, NULL FROM part WHERE p_partkey % 2 = 0)""")
def description_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named facts in their order, whatever the map's; product_type, model_number and blanks are none; extras come last."""
    known = F.create_map(F.lit("voltage"), F.lit("2.8-4 V"), F.lit("size"), F.concat(F.col("p_size").cast("string"), F.lit(" mm")), F.lit("product_type"), F.col("p_name"), F.lit("model_number"), F.lit("M1"), F.lit("color"), F.lit(" "), F.lit("material"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")))
    extras = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("terminal_kind"), F.col("p_type"), F.lit("nothing"), F.lit(None).cast("string")))
    return standin.part(spark, sf_dir).select("p_partkey", F.posexplode(attributes.from_description(known, extras)).alias("place", "a")).select("p_partkey", "place", "a.label", "a.candidate_value", "a.candidate_uom", "a.confidence")


@query(f"WITH {standin.TAXONOMY_SQL} SELECT fine, CASE fine WHEN 'Valves' THEN 'valve' ELSE left(fine, length(fine) - 1) END AS singular FROM tax")
def singularize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.taxonomy(spark).select("fine", text.singular("fine").alias("singular"))


# -- Texts -----------------------------------------------------------------------------------------------------------
def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.with_content(_products(spark, sf_dir))


def _one(name: str) -> Query:
    return lambda spark, sf_dir: _content(spark, sf_dir).select("p_partkey", F.try_element_at("descriptions", F.lit(name)).alias("text"))


_TEXTS = {
    "invoice_desc": ("INVOICE_DESC", "left(concat_ws(' ', upper(kind), upper(mount), cyc, short_mat, CASE WHEN volt = '240.0' THEN '240' ELSE volt END || 'V', amp || upper(amp_uom)), 40)"),
    "mobile_desc": ("MOBILE_DESC", "concat_ws(', ', manufacturer || ' ' || plain, kind, mpn)"),
    "short_desc": ("SHORT_DESC", "concat_ws(', ', concat_ws(' ', brand, mpn, kind, 'With ' || w), mount || ' Mounting', cyc || ' Wash Cycles', mat)"),
    "retail_desc": ("RETAIL_DESC", "concat_ws(', ', kind, mount || ' Mounting', cyc || '-Wash Cycle', mat)"),
    "long_desc": ("LONG_DESC1", "concat_ws(', ', concat_ws(' ', brand, kind, 'With ' || w), cyc || ' Wash Cycles', volts, amps, sounds, mat)"),
}
for _name, (_field, _expr) in _TEXTS.items():
    QUERIES[_name] = _one(_field)
    SQL[_name] = _CONTENT_SQL + f"SELECT p_partkey, {_expr} AS text FROM x"

_PHRASES = "list_slice(list_concat(list_filter(['a quiet ' || sounds || ' sound rating', cyc || ' wash cycles to choose from', volts || ' operation', 'a ' || mat || ' construction'], lambda v: v IS NOT NULL), feats), 1, 4)"
QUERIES["marketing_desc"] = _one("MARKETING_DESCRIPTION")
SQL["marketing_desc"] = _CONTENT_SQL + f", y AS (SELECT *, {_PHRASES} AS ph FROM x) SELECT p_partkey, brand || ' ' || kind || ' offers ' || CASE WHEN len(ph) = 1 THEN ph[1] ELSE array_to_string(ph[:-2], ', ') || ', and ' || ph[-1] END || ' for dependable everyday performance' || coalesce(', and comes equipped ' || lower(w) || '.', '.') AS text FROM y"


@query(_CONTENT_SQL + "SELECT p_partkey, array_to_string(list_concat(feats, list_filter(['Sound Level: ' || sounds, cyc || ' Wash Cycles', 'Voltage: ' || volts, 'Amperage: ' || amps, 'Material: ' || mat, 'Color: ' || color, 'Mounting: ' || mount, 'Size: ' || size, 'With ' || w], lambda v: v IS NOT NULL)), ' / ') AS bullets FROM x")
def feature_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir).select("p_partkey", F.array_join("features", " / ").alias("bullets"))


# -- Validation and scores -------------------------------------------------------------------------------------------
_SCORED_SQL = f"""WITH {_ATTR_SQL}, rt AS (SELECT p_partkey, round(coalesce(avg(CAST(lov_matched AS INT)) FILTER (WHERE value IS NOT NULL), 1.0), 4) AS lov, round(coalesce(avg(CAST(uom IN {oracles.KNOWN_UNITS} AS INT)) FILTER (WHERE uom IS NOT NULL), 1.0), 4) AS unit, round(coalesce(avg(CAST(length(trim(coalesce(source, ''))) > 0 AS INT)) FILTER (WHERE value IS NOT NULL), 1.0), 4) AS ground,
  max(CAST(needs_review AS INT)) = 1 AS flagged, count(*) FILTER (WHERE value IS NOT NULL) AS valued FROM attr GROUP BY p_partkey),
sr AS (SELECT *, round(0.25 * (p_partkey % 100) / 99.0 + 0.25 * 0.65 + 0.2 * lov + 0.15 * unit + 0.15 * ground, 4) AS overall FROM rt), st AS (SELECT *, CASE WHEN overall > 0.85 THEN 'HIGH' WHEN overall >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS status FROM sr) """


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _content(spark, sf_dir)
    return validate.scored(df.withColumn("manufacturer_confidence", (F.col("p_partkey") % 100) / F.lit(99.0)).withColumn("classification_confidence", F.lit(0.65)))


@query(_SCORED_SQL + "SELECT p_partkey, lov, unit, ground FROM rt")
def lov_uom_grounding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("p_partkey", F.col("validation.lov_rate").alias("lov"), F.col("validation.uom_rate").alias("unit"), F.col("validation.grounding_rate").alias("ground"))


@query("SELECT doc_id, length(text) <= 40 AS invoice_ok, CAST(NULL AS BOOLEAN) AS short_ok FROM documents")
def char_limit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", validate.within_limit("INVOICE_DESC", F.col("text")).alias("invoice_ok"), validate.within_limit("SHORT_DESC", F.col("text")).alias("short_ok"))


@query(f"""WITH {_ATTR_SQL}, i AS (SELECT p_partkey, 0 AS g, pos, 'LOV non-compliance: attribute ''' || label || ''' value=''' || value || ''' not LOV-matched -- needs human review' AS s FROM attr WHERE value IS NOT NULL AND NOT lov_matched
 UNION ALL SELECT p_partkey, 1, pos, 'UOM non-compliance: attribute ''' || label || ''' uom=''' || uom || ''' not in approved UOM set' FROM attr WHERE uom IS NOT NULL AND uom NOT IN {oracles.KNOWN_UNITS}
 UNION ALL SELECT p_partkey, 2, pos, 'Ungrounded: attribute ''' || label || ''' value=''' || value || ''' has no source -- needs review' FROM attr WHERE value IS NOT NULL AND trim(coalesce(source, '')) = '')
SELECT p_partkey, true AS valid, coalesce(string_agg(s, ' / ' ORDER BY g, pos), '') AS issues FROM part LEFT JOIN i USING (p_partkey) GROUP BY p_partkey""")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("p_partkey", "validation.valid", F.array_join("validation.issues", " / ").alias("issues"))


@query(_SCORED_SQL + "SELECT p_partkey, overall, status, status = 'LOW' OR flagged AS needs_review FROM st")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("p_partkey", "confidence.overall", "confidence.status", "confidence.needs_review")


_PCT = lambda c, d: f"printf('%.{d}f%%', 100 * {c})"
_QUOTED = "chr(39) || label || chr(39)"


@query(f"""{_SCORED_SQL}, r AS (
  SELECT p_partkey, 1 AS g, 0 AS pos, 'Overall confidence score (' || {_PCT("overall", 2)} || ') is LOW (< 60%)' AS reason FROM st WHERE status = 'LOW'
  UNION ALL SELECT p_partkey, 2, 0, 'Manufacturer match confidence is low (' || {_PCT("(p_partkey % 100) / 99.0", 2)} || ')' FROM st WHERE (p_partkey % 100) / 99.0 < 0.7
  UNION ALL SELECT p_partkey, 3, 0, 'Classification confidence is low (65.00%)' FROM st
  UNION ALL SELECT p_partkey, 4, 0, count(*) || ' attribute(s) not LOV-matched: ' || array_to_string(list_slice(list({_QUOTED} ORDER BY pos), 1, 3), ', ') || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ' more)' ELSE '' END FROM attr WHERE value IS NOT NULL AND NOT lov_matched GROUP BY p_partkey
  UNION ALL SELECT p_partkey, 5, 0, 'UOM compliance rate is ' || {_PCT("unit", 1)} || ' (contains unapproved unit)' FROM st WHERE unit < 1
  UNION ALL SELECT p_partkey, 6, 0, count(*) || ' attribute(s) lack source grounding' FROM attr WHERE value IS NOT NULL AND coalesce(source, '') = '' GROUP BY p_partkey
  UNION ALL SELECT p_partkey, 7, pos, 'Attribute ' || {_QUOTED} || ' flagged with needs_review=True' FROM attr WHERE needs_review)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY g, pos) - 1 AS INT) AS n, reason FROM r""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The outer form: for the plain one Spark infers a filter, and copies all that the reasons rest on into it.
    return _scored(spark, sf_dir).select("p_partkey", F.posexplode_outer("confidence.reasons").alias("n", "reason")).where("n IS NOT NULL")


# -- Delivery --------------------------------------------------------------------------------------------------------
def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir).withColumn("classpath", F.concat_ws(">", "dept", "class_name", "fine")).drop("dept")


@query(_CONTENT_SQL + "SELECT mpn AS \"Mfg_Part_Num\", 'Goods' AS \"Dept\", kind || 's' AS \"Fine\", '-- No DIB Brand --' AS \"DIB_Brand\", plain || '_' || mpn || '.jpg' AS image, 'Yes' AS actual, coalesce(mat, '') AS value2, 252 AS n FROM x")
def delivery_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = delivery.delivery(_delivered(spark, sf_dir))
    return out.select("Mfg_Part_Num", "Dept", "Fine", "DIB_Brand", F.col("Product Image").alias("image"), F.col("Actual Image (Yes/No)").alias("actual"), F.col("`ATTRIBUTE_VALUE 2`").alias("value2"), F.lit(len(out.columns)).alias("n"))


@query(f"WITH {_ATTR_SQL} SELECT p_partkey, count(*) AS slots, string_agg(label || '=' || coalesce(value, '') || coalesce(uom, ''), '/' ORDER BY pos) AS joined FROM attr GROUP BY p_partkey")
def attribute_slots_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = delivery.delivery(_products(spark, sf_dir).withColumn("part_number_key", F.col("p_partkey")).withColumnRenamed("part_number_key", "UPC"), ["UPC", *(f"ATTRIBUTE_{p} {i}" for i in range(1, 51) for p in ("LABEL", "VALUE", "UOM"))])
    back = delivery.slots_to_attributes(wide)
    joined = F.array_join(F.transform(back, lambda a: F.concat(a["label"], F.lit("="), F.coalesce(a["value"], F.lit("")), F.coalesce(a["uom"], F.lit("")))), "/")
    return wide.select(F.col("UPC").cast("long").alias("p_partkey"), F.size(back).cast("long").alias("slots"), joined.alias("joined"))


@query(f"WITH {_ATTR_SQL} SELECT p_partkey, replace(string_agg(label || ':' || concat_ws(' ', value, uom), ' | ' ORDER BY pos), ',', ';') AS flat FROM attr GROUP BY p_partkey")
def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir).select("p_partkey", delivery.flat_attributes(F.col("attributes")).alias("flat"))


@query(_WITH + "SELECT row_id, mpn FROM cln WHERE p_partkey < 12")
def recent_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve rows of a list view, by index."""
    return tables.first_rows(_cleaned(spark, sf_dir, "p_partkey"), "p_partkey", 12).select("row_id", "mpn")


# -- Metrics ---------------------------------------------------------------------------------------------------------
@query(_SCORED_SQL + "SELECT count(*) AS products, count(*) FILTER (WHERE status = 'HIGH') AS high, count(*) FILTER (WHERE status = 'LOW' OR flagged) AS needs_review, CAST(0 AS BIGINT) AS invalid, round(avg(lov), 4) AS lov_rate, round(avg(unit), 4) AS uom_rate, round(avg(ground), 4) AS grounding_rate, round(avg(overall), 4) AS confidence FROM st")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.batch_metrics(_scored(spark, sf_dir))


@query(f"WITH {_ATTR_SQL} SELECT count(*) AS claims, count(*) FILTER (WHERE trim(coalesce(source, '')) <> '') AS \"grounded\", round(count(*) FILTER (WHERE trim(coalesce(source, '')) <> '') / count(*), 4) AS rate FROM attr WHERE trim(coalesce(value, '')) <> ''")
def pooled_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pooled_grounding(_products(spark, sf_dir))


_ACC = "SELECT l.doc_id, CASE WHEN n_chars > 200 THEN '1' ELSE 'None' END AS pq, CASE WHEN quality = 1 THEN ' 1 ' END AS eq, CASE WHEN d.lang = 'en' THEN 'EN' ELSE 'x' END AS pt, CASE WHEN toxic = 1 THEN 'x' ELSE 'en' END AS et FROM labels l JOIN documents d USING (doc_id)"


@query(f"WITH a AS ({_ACC}), h AS (SELECT count(*) AS n, round(avg(CAST(CASE WHEN lower(pq) = 'none' THEN '' ELSE pq END = coalesce(trim(eq), '') AS INT)), 4) AS q, round(avg(CAST(lower(pt) = et AS INT)), 4) AS t FROM a) SELECT 'quality' AS field, n, q AS accuracy FROM h UNION ALL SELECT 'tone', n, t FROM h UNION ALL SELECT '(overall)', n, round((q + t) / 2, 4) FROM h")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    predicted = docs.select("doc_id", F.expr("CASE WHEN n_chars > 200 THEN '1' ELSE 'None' END").alias("quality"), F.expr("CASE WHEN lang = 'en' THEN 'EN' ELSE 'x' END").alias("tone"))
    expected = labels.select("doc_id", F.expr("CASE WHEN quality = 1 THEN ' 1 ' END").alias("quality"), F.expr("CASE WHEN toxic = 1 THEN 'x' ELSE 'en' END").alias("tone"))
    return metrics.field_accuracy(predicted, expected, "doc_id", ["quality", "tone"]).drop("warning")


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumn("classpath", F.when(F.col("p_partkey") % 3 > 0, "a>b")).withColumn("brand_name", F.when(F.col("p_partkey") % 4 > 0, F.col("brand_name")).otherwise(" "))


@query(_SCORED_SQL + ", c AS (SELECT p_partkey, count(*) FILTER (WHERE trim(coalesce(value, '')) <> '') AS k FROM attr GROUP BY p_partkey) SELECT round(avg(CAST(p_partkey % 3 > 0 AS INT)), 4) AS with_classpath, 1.0::DOUBLE AS with_manufacturer, round(avg(CAST(p_partkey % 4 > 0 AS INT)), 4) AS with_brand, round(avg(k), 2) AS mean_attributes, round(avg(CAST(status = 'LOW' OR flagged AS INT)), 4) AS review_share FROM st JOIN c USING (p_partkey)")
def structural_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.completeness(_complete(spark, sf_dir))


@query(_SCORED_SQL + "SELECT count(*) AS products, count(*) FILTER (WHERE status = 'HIGH') AS high, count(*) FILTER (WHERE status = 'LOW' OR flagged) AS needs_review, CAST(0 AS BIGINT) AS invalid, round(avg(lov), 4) AS lov_rate, round(avg(unit), 4) AS uom_rate, round(avg(ground), 4) AS grounding_rate, round(avg(overall), 4) AS confidence, (SELECT round(count(*) FILTER (WHERE trim(coalesce(source, '')) <> '') / count(*), 4) FROM attr WHERE trim(coalesce(value, '')) <> '') AS pooled_grounding, 1.0::DOUBLE AS field_accuracy, round(count(*) FILTER (WHERE status = 'LOW' OR flagged) / count(*), 4) AS review_share FROM st")
def full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.full_evaluation(_scored(spark, sf_dir), _products(spark, sf_dir).withColumn("brand_name", F.upper("brand_name")), "p_partkey", ["brand_name", "fine"])


# -- Review ----------------------------------------------------------------------------------------------------------
_EVENTS_SQL = "ev AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit' ELSE 'view' END AS decision, ts AS happened, event_id AS seq FROM events), cur AS (SELECT key, arg_max(decision, {'h': happened, 's': seq}) AS decision, max(happened) AS happened FROM ev WHERE decision IN ('accept', 'reject', 'edit') GROUP BY key)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.expr("CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit' ELSE 'view' END").alias("decision"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = _scored(spark, sf_dir).withColumn("key", F.col("p_partkey").cast("string"))
    return review.upsert(products, review.current(_events(spark, sf_dir)))


@query(f"WITH {_EVENTS_SQL} SELECT key, decision, strftime(happened, '%Y-%m-%d %H:%M:%S.%f') AS \"at\" FROM cur")
def review_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.current(_events(spark, sf_dir)).select("key", "decision", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query(f"WITH {_EVENTS_SQL} SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 5 = 0 THEN 'accept' ELSE decision END AS decision FROM part LEFT JOIN cur ON key = CAST(p_partkey AS VARCHAR)")
def review_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = standin.part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("key"))
    local = standin.part(spark, sf_dir).where("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("key"), F.lit("accept").alias("decision"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return review.overlay(products, review.current(_events(spark, sf_dir)), local).select("key", "decision")


@query(f"WITH {_EVENTS_SQL} SELECT CAST(p_partkey AS VARCHAR) AS key, decision, CASE WHEN decision = 'edit' THEN 'edited ' || decision ELSE p_name END AS descriptions FROM part LEFT JOIN cur ON key = CAST(p_partkey AS VARCHAR)")
def review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = standin.part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("descriptions"))
    return review.upsert(products, review.current(_events(spark, sf_dir)).withColumn("descriptions", F.concat(F.lit("edited "), "decision"))).select("key", "decision", "descriptions")


@query(_SCORED_SQL + f", {_EVENTS_SQL} SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN decision IN ('accept', 'reject') THEN 'resolved' ELSE 'open' END AS state FROM st LEFT JOIN cur ON key = CAST(p_partkey AS VARCHAR) WHERE status = 'LOW' OR flagged")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.queue(_reviewed(spark, sf_dir)).select("key", "state")


@query(_SCORED_SQL + f", {_EVENTS_SQL}, z AS (SELECT *, status = 'LOW' OR flagged AS fl FROM st LEFT JOIN cur ON key = CAST(p_partkey AS VARCHAR)) SELECT count(*) FILTER (WHERE fl) AS flagged, count(*) FILTER (WHERE fl AND decision IN ('accept', 'reject')) AS resolved, count(*) FILTER (WHERE decision = 'accept') AS approved, count(*) FILTER (WHERE decision = 'reject') AS rejected, round(count(*) FILTER (WHERE fl AND decision IN ('accept', 'reject')) / count(*) FILTER (WHERE fl), 4) AS share FROM z")
def triage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.progress(_reviewed(spark, sf_dir))


@query(_WITH + "SELECT row_id FROM cln WHERE lower(concat_ws(' / ', mpn, part_desc, unilog_brand)) LIKE '%gear%'")
def search_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.search(_cleaned(spark, sf_dir), " GEAR ", ["mpn", "part_desc", "unilog_brand"]).select("row_id")


# -- The whole -------------------------------------------------------------------------------------------------------
def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = standin.part(spark, sf_dir)
    rows = standin.catalogue(p.withColumn("candidates", standin.candidates()), "candidates")
    return enrich(rows, References(standin.taxonomy(spark), None, standin.master(p)))


_SINGULAR = "CASE fine WHEN 'Bolts' THEN 'BOLT' WHEN 'Rings' THEN 'RING' WHEN 'Anvils' THEN 'ANVIL' WHEN 'Gears' THEN 'GEAR' WHEN 'Plates' THEN 'PLATE' WHEN 'Valves' THEN 'VALVE' END"
_ENRICH_SQL = f"""WITH RECURSIVE {_CONTENT_SQL.removeprefix("WITH ").rstrip()}, {_SCORED_SQL[_SCORED_SQL.index("rt AS"):_SCORED_SQL.index(", st AS")]}, {standin.CATALOGUE_SQL}, {_CLEANED_SQL}, {standin.TAXONOMY_SQL},
t AS (SELECT DISTINCT lower(part_desc) AS text FROM cln WHERE part_desc IS NOT NULL), {_KEYWORD_SQL}, rest AS (SELECT text FROM t WHERE text NOT IN (SELECT text FROM keyed)), {_LIKE_SQL},
every AS (SELECT text, dept, class_name, fine, confidence FROM keyed UNION ALL SELECT text, dept, class_name, fine, round(score, 4) FROM liked WHERE rank = 1 AND score >= 0.3),
e AS (SELECT c.*, y.dept, y.class_name, y.fine, round(0.25 * 0.35 + 0.25 * coalesce(y.confidence, 0) + 0.2 * lov + 0.15 * unit + 0.15 * ground, 4) AS overall, flagged, lov, unit, ground,
    left(concat_ws(' ', {_SINGULAR.replace("fine", "y.fine")}, upper(mount), cyc, short_mat, CASE WHEN volt = '240.0' THEN '240' ELSE volt END || 'V', amp || upper(amp_uom)), 40) AS invoice, b.p_brand
  FROM cln c JOIN rt ON rt.p_partkey = c.p_partkey JOIN x ON x.p_partkey = c.p_partkey JOIN part b ON b.p_partkey = c.p_partkey LEFT JOIN every y ON y.text = lower(c.part_desc))
SELECT row_id, mpn, coalesce(part_manuf, unilog_brand, e1_brand, dib_brand) AS manufacturer_name, CASE WHEN coalesce(unilog_brand, e1_brand, dib_brand) IS NOT NULL THEN p_brand END AS brand_name,
  dept || '>' || class_name || '>' || fine AS classpath, invoice, overall, CASE WHEN overall > 0.85 THEN 'HIGH' WHEN overall >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS status, overall < 0.6 OR flagged AS needs_review FROM e"""


@query(_ENRICH_SQL)
def enrich_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("row_id", "mpn", "manufacturer_name", "brand_name", "classpath", F.try_element_at("descriptions", F.lit("INVOICE_DESC")).alias("invoice"), "confidence.overall", "confidence.status", "confidence.needs_review")
