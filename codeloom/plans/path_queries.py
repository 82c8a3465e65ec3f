"""Queries over paths, snapshots, three-valued logic and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import fuzzy, paths
from codeloom.operators import changelog, history, symbols
from codeloom.session import table
from codeloom.streaming import service


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """path, mtime of the newest listing of each path; a path listed under several roots counts once."""
    rows = table(spark, d, "file_listing").filter("path IS NOT NULL").select("path", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"))
    return rows.groupBy("path").agg(F.max("is_dir").alias("is_dir"), F.max("mtime").alias("mtime"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    rows = changelog.file_log(table(spark, d, "file_history")).filter("NOT removed AND file_timestamp IS NOT NULL")
    return rows.groupBy("path").agg(F.max("file_timestamp").alias("ts"))


def path_names(spark, d):
    """Module and display names of every module id that is a path."""
    p = F.col("id")
    ids = table(spark, d, "modules").select("module_key.id").filter("id LIKE '/%'").distinct()
    return ids.select(
        "id", paths.module_basename(p).alias("module"), paths.shorten_path(p).alias("short"), paths.directory(p).alias("directory"), paths.dotted_module(F.expr("substring(id, 2)")).alias("dotted"),
        paths.is_python_file(p).alias("is_python"), paths.strip_underscores(paths.module_basename(p)).alias("public_name"), F.size(paths.ancestors(p)).alias("depth"),
    )


def file_distance(spark, d):
    """Distance of each module from the folder its location names."""
    m = table(spark, d, "modules").select("module_row_id", "module_key", "location").distinct()
    far = symbols.module_distance(F.col("module_key.module_source_type"), F.col("module_key.id"), F.regexp_replace("location", "/$", ""))
    return m.select("module_row_id", far.alias("distance"))


def location_routing(spark, d):
    where = table(spark, d, "modules").select("location").filter("location LIKE '/%'").distinct()
    return symbols.route_to_location(_listed(spark, d).select("path"), where)


def relative_names(spark, d):
    """Dotted names with one to three dots in front as paths, and joined with an attribute."""
    terms = table(spark, d, "trie_terms").select("term").filter("term IS NOT NULL").distinct()
    rel = terms.select("term", F.explode(F.array(*[F.lit("." * n) for n in range(4)])).alias("dots")).withColumn("name", F.concat("dots", "term"))
    return rel.select("name", paths.relative_module_path(F.col("name")).alias("path"), paths.join_attribute(F.col("name"), F.lit("x")).alias("joined"), paths.join_names(F.col("dots"), F.lit(""), F.lit(None).cast("string"), F.col("term")).alias("plain"))


def import_text(spark, d):
    """The statement each alias stands for."""
    a = table(spark, d, "symbol_aliases").select("alias_id", "as_name", "real_name", "module_key.id", "is_module_itself").distinct()
    value = F.when(~F.coalesce("is_module_itself", F.lit(False)), F.col("real_name"))
    return a.select("alias_id", paths.import_statement(paths.module_basename(F.col("id")), value, F.col("as_name")).alias("statement"))


def snapshot_diff(spark, d):
    return history.snapshot_diff(_listed(spark, d).filter("NOT is_dir AND path NOT LIKE '%/'"), _stored(spark, d), "path", "mtime", "ts")


def removed_paths(spark, d):
    """Stored files that are gone, and the directories that went with them."""
    listed = _listed(spark, d).filter("NOT is_dir AND path NOT LIKE '%/'")
    gone = _stored(spark, d).join(listed, "path", "left_anti")
    return history.removed_with_directories(gone, listed)


def history_upsert(spark, d):
    seen = table(spark, d, "file_listing").filter("path IS NOT NULL").select("path", F.coalesce("mtime", F.lit(0.0)).alias("ts"), F.unix_micros(F.col("listed_at").cast("timestamp")).alias("seq"))
    return history.upsert(_stored(spark, d), seen)


def _module_paths(spark, d):
    return table(spark, d, "modules").select(F.col("module_key.id").alias("path")).filter("path LIKE '/%'")


def package_files(spark, d):
    """What walks from every folder above a module meet."""
    m = _module_paths(spark, d)
    roots = m.select(F.explode(paths.beginnings(paths.directory(F.col("path")))).alias("root")).distinct()
    return history.package_files(m, roots)


def full_module_names(spark, d):
    return history.full_module_names(_module_paths(spark, d))


def modules_under(spark, d):
    return history.modules_under(_module_paths(spark, d), "/srv/code", ["/tools/", "_pe"])


def update_log_report(spark, d):
    e = table(spark, d, "events")
    return history.update_report(e.select(F.col("event_type").alias("action_type"), F.col("ts").alias("timestamp")))


def kleene_tables(spark, d):
    three = [(True,), (None,), (False,)]
    pairs = spark.createDataFrame(three, "a boolean").withColumn("b", F.explode(F.array(F.lit(True), F.lit(None), F.lit(False))))
    return pairs.select("a", "b", (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), (~F.col("a")).alias("inverted"))


def fuzzy_instance_of(spark, d):
    """Per module: may all, some or none of its entries be functions? Unknown and ambiguous types are maybe."""
    e = table(spark, d, "symbol_entries").select("entry_id", "module_key", "symbol_type").distinct()
    is_function = F.when(~F.col("symbol_type").isin(4, 5), F.col("symbol_type") == 1)
    by = e.groupBy("module_key").agg(fuzzy.all_true_agg(is_function).alias("is_function"))
    return by.select(F.col("module_key.module_source_type").alias("module_type"), F.col("module_key.id").alias("module_id"), "is_function")


def column_operators(spark, d):
    """Python's operators on whole numbers; null where Python would raise."""
    n = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("a"), (F.col("l_partkey") % 7 - 3).alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    ops = {"add": "+", "sub": "-", "mul": "*", "div": "/", "floordiv": "//", "mod": "%", "bit_and": "&", "bit_or": "|", "bit_xor": "^"}
    return n.select("a", "b", *[fuzzy.BINARY[o](a, b).cast("double").alias(k) for k, o in ops.items()], fuzzy.UNARY["-"](b).alias("neg"), fuzzy.UNARY["~"](a).alias("inv"))


def item_access(spark, d):
    """Items of an array with Python's negative indices; unknown beyond its ends."""
    n = table(spark, d, "lineitem").select((F.col("l_partkey") % 9 - 4).alias("i")).distinct()
    values = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return n.select("i", fuzzy.item(values, F.col("i")).alias("item"), fuzzy.is_ambiguous(F.slice(values, 1, F.abs(F.col("i")).cast("int"))).alias("ambiguous"), fuzzy.single_value(F.slice(values, 1, F.abs(F.col("i")).cast("int"))).alias("single"))


def number_literals(spark, d):
    k = table(spark, d, "orders").select("o_orderkey").distinct()
    text = F.concat(F.element_at(F.array(F.lit(""), F.lit("0x"), F.lit("0o"), F.lit("0b"), F.lit("1_")), (F.col("o_orderkey") % 5 + 1).cast("int")), F.col("o_orderkey").cast("string"))
    return k.select("o_orderkey", text.alias("text"), paths.number_literal(text).alias("number"))


def request_router(spark, d):
    """Requests made of the events, by how they are routed."""
    e = table(spark, d, "events")
    command = F.when(F.col("event_type") == "click", '"get_capabilities"').when(F.col("event_type") == "view", '"nothing"').when(F.col("event_type") == "purchase", '"fix_code_in_file","source":"x","filename":"f.py"').otherwise("null")
    line = F.when(F.col("event_id") % 10 == 9, F.col("props").substr(1, 3)).otherwise(F.concat(F.lit('{"request_id":'), (F.col("event_id") % 4).cast("string"), F.lit(',"command_id":'), command, F.lit("}")))
    return service.routed(e.select(line.alias("value"))).groupBy("command", "failure").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (path_names, file_distance, location_routing, relative_names, import_text, snapshot_diff, removed_paths, history_upsert, package_files, full_module_names, modules_under, update_log_report, kleene_tables, fuzzy_instance_of, column_operators, item_access, number_literals, request_router)
}

_LISTED = "listed AS (SELECT path, bool_or(coalesce(is_dir, false)) AS is_dir, max(coalesce(mtime, 0)) AS mtime FROM file_listing WHERE path IS NOT NULL GROUP BY path), files AS (SELECT * FROM listed WHERE NOT is_dir AND path NOT LIKE '%/')"
_STORED = "stored AS (SELECT path, max(file_timestamp) AS ts FROM file_history WHERE path NOT LIKE '%/' AND NOT removed AND file_timestamp IS NOT NULL GROUP BY path)"
_UP = "list_transform(range(1, len(string_split(dir, '/')) + 1), lambda i: array_to_string(list_slice(string_split(dir, '/'), 1, i), '/') || '/')"
_FILES = r"m AS (SELECT DISTINCT module_key.id AS path, regexp_extract(module_key.id, '^(.*)/[^/]*$', 1) AS dir FROM modules WHERE module_key.id LIKE '/%'), f AS (SELECT * FROM m WHERE regexp_matches(path, '\.pyi?$'))"
_BASE = r"CASE WHEN regexp_matches({0}, '(^|/)__init__\.pyi?$') THEN coalesce(list_extract(string_split({0}, '/'), -2), '') ELSE split_part(list_extract(string_split({0}, '/'), -1), '.', 1) END"

ORACLES = {
    "path_names": rf"""WITH ids AS (SELECT DISTINCT module_key.id AS id FROM modules WHERE module_key.id LIKE '/%'), p AS (SELECT id, regexp_extract(id, '^(.*)/[^/]*$', 1) AS directory, regexp_replace(id, '/[^/]*/?$', '') AS dir, {_BASE.format("id")} AS module FROM ids)
        SELECT id, module, array_to_string(list_transform(string_split(directory, '/'), lambda s: array_to_string(list_transform(string_split(s, '_'), lambda x: x[1:1]), '_')), '/') || '/' || list_extract(string_split(id, '/'), -1) AS short,
        directory, CASE WHEN regexp_matches(id, '/__init__\.pyi?$') THEN replace(directory[2:], '/', '.') ELSE replace(directory[2:], '/', '.') || CASE WHEN directory[2:] = '' THEN '' ELSE '.' END || module END AS dotted,
        regexp_matches(id, '\.pyi?$') AS is_python, ltrim(module, '_') AS public_name, CAST(len(string_split(dir, '/')) AS INTEGER) AS depth FROM p""",
    "file_distance": """WITH m AS (SELECT DISTINCT module_row_id, module_key.module_source_type AS t, string_split(module_key.id, '/') AS x, string_split(regexp_replace(location, '/$', ''), '/') AS y FROM modules)
        SELECT module_row_id, CAST(CASE WHEN t IN (1, 3) THEN greatest(len(x), len(y)) - len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: list_slice(x, 1, i) = list_slice(y, 1, i))) ELSE 4 END AS INTEGER) AS distance FROM m""",
    "location_routing": f"WITH {_LISTED}, l AS (SELECT DISTINCT location FROM modules WHERE location LIKE '/%') SELECT path, max_by(location, length(location)) AS location FROM listed LEFT JOIN l ON starts_with(path, location) AND length(rtrim(path, '/')) > length(location) - 1 GROUP BY path",
    "relative_names": """WITH t AS (SELECT DISTINCT term, repeat('.', n) AS dots FROM trie_terms, range(0, 4) r(n) WHERE term IS NOT NULL)
        SELECT dots || term AS name, CASE WHEN dots || term = '.' THEN '.' ELSE CASE length(regexp_extract(dots || term, '^(\\.*)', 1)) WHEN 1 THEN './' WHEN 0 THEN '' ELSE repeat('../', length(regexp_extract(dots || term, '^(\\.*)', 1)) - 1) END
        || replace(regexp_replace(dots || term, '^\\.+', ''), '.', '/') END AS path, dots || term || CASE WHEN ends_with(dots || term, '.') THEN '' ELSE '.' END || 'x' AS joined,
        CASE WHEN dots = '' THEN term ELSE dots || '.' || term END AS plain FROM t""".replace("\\\\", "\\"),
    "import_text": f"""WITH a AS (SELECT DISTINCT alias_id, as_name, real_name, module_key.id AS id, coalesce(is_module_itself, false) AS f FROM symbol_aliases), b AS (SELECT *, {_BASE.format("id")} AS m, CASE WHEN as_name <> '' THEN ' as ' || as_name ELSE '' END AS al FROM a)
        SELECT alias_id, CASE WHEN f OR real_name IS NULL OR real_name = '' THEN 'import ' || m || al ELSE 'from ' || m || ' import ' || real_name || al END AS statement FROM b""",
    "snapshot_diff": f"WITH {_LISTED}, {_STORED} SELECT path, CASE WHEN ts IS NULL THEN 'added' WHEN mtime IS NULL THEN 'removed' ELSE 'modified' END AS change FROM files FULL JOIN stored USING (path) WHERE ts IS NULL OR mtime IS NULL OR mtime > ts",
    "removed_paths": f"""WITH {_LISTED}, {_STORED}, gone AS (SELECT path FROM stored ANTI JOIN files USING (path)), g AS (SELECT DISTINCT unnest({_UP}) AS path FROM (SELECT regexp_replace(path, '/[^/]*/?$', '') AS dir FROM gone)),
        f AS (SELECT DISTINCT unnest({_UP}) AS path FROM (SELECT regexp_replace(path, '/[^/]*/?$', '') AS dir FROM files)) SELECT path FROM gone UNION ALL SELECT path FROM g ANTI JOIN f USING (path)""",
    "history_upsert": f"WITH {_STORED} SELECT path, ts FROM (SELECT path, ts, -1 AS seq FROM stored UNION ALL SELECT path, coalesce(mtime, 0), epoch_us(listed_at) FROM file_listing WHERE path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, ts DESC) = 1",
    "package_files": rf"""WITH RECURSIVE {_FILES}, packages AS (SELECT DISTINCT dir, regexp_extract(dir, '^(.*)/[^/]*$', 1) AS parent FROM f WHERE ends_with(path, '/__init__.py') AND NOT ends_with(dir, '/.git')),
        roots AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(dir, '/')) + 1), lambda i: array_to_string(list_slice(string_split(dir, '/'), 1, i), '/'))) AS root FROM m),
        walk AS (SELECT root, root AS folder FROM roots UNION ALL SELECT root, dir FROM walk JOIN packages ON parent = folder) SELECT root, path FROM walk JOIN f ON dir = folder""",
    "full_module_names": rf"""WITH RECURSIVE {_FILES}, packages AS (SELECT DISTINCT dir FROM f WHERE ends_with(path, '/__init__.py') AND NOT ends_with(dir, '/.git')),
        climb AS (SELECT path, dir AS folder, coalesce(nullif(regexp_replace(list_extract(string_split(path, '/'), -1), '\.[^.]*$', ''), '__init__'), '') AS name FROM f
          UNION ALL SELECT path, regexp_extract(folder, '^(.*)/[^/]*$', 1), list_extract(string_split(folder, '/'), -1) || CASE WHEN name = '' THEN '' ELSE '.' || name END FROM climb WHERE folder IN (SELECT dir FROM packages))
        SELECT path, name AS full_name, folder AS package_root FROM climb WHERE folder NOT IN (SELECT dir FROM packages)""",
    "modules_under": rf"WITH {_FILES} SELECT path FROM f WHERE starts_with(path, '/srv/code/') AND NOT contains(path, '/tools/') AND NOT contains(path, '_pe')",
    "update_log_report": "SELECT event_type AS action_type, CAST(ts AS DATE) AS day, count(*) AS n_actions FROM events GROUP BY 1, 2",
    "kleene_tables": "WITH t AS (SELECT unnest([true, NULL, false]) AS x) SELECT l.x AS a, r.x AS b, l.x AND r.x AS both, l.x OR r.x AS either, NOT l.x AS inverted FROM t l, t r",
    "fuzzy_instance_of": """WITH e AS (SELECT DISTINCT entry_id, module_key, CASE WHEN symbol_type NOT IN (4, 5) THEN symbol_type = 1 END AS x FROM symbol_entries),
        m AS (SELECT module_key, CASE WHEN count(*) FILTER (x) = count(*) THEN true WHEN count(*) FILTER (coalesce(x, true)) > 0 THEN NULL ELSE false END AS v FROM e GROUP BY module_key)
        SELECT module_key.module_source_type AS module_type, module_key.id AS module_id, v AS is_function FROM m""",
    "column_operators": """WITH n AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS a, l_partkey % 7 - 3 AS b FROM lineitem), q AS (SELECT *, CASE WHEN b <> 0 THEN floor(CAST(a AS DOUBLE) / b) END AS f FROM n)
        SELECT a, b, CAST(a + b AS DOUBLE) AS add, CAST(a - b AS DOUBLE) AS sub, CAST(a * b AS DOUBLE) AS mul, CASE WHEN b <> 0 THEN CAST(a AS DOUBLE) / b END AS div, f AS floordiv, a - b * f AS mod,
        CAST(a & b AS DOUBLE) AS bit_and, CAST(a | b AS DOUBLE) AS bit_or, CAST(xor(a, b) AS DOUBLE) AS bit_xor, -b AS neg, -a - 1 AS inv FROM q""",
    "item_access": """WITH n AS (SELECT DISTINCT l_partkey % 9 - 4 AS i FROM lineitem) SELECT i, CASE WHEN i >= 0 THEN list_extract(['a', 'b', 'c'], i + 1) ELSE list_extract(['a', 'b', 'c'], i) END AS item,
        least(abs(i), 3) <> 1 AS ambiguous, CASE WHEN abs(i) = 1 THEN 'a' END AS single FROM n""",
    "number_literals": """WITH k AS (SELECT DISTINCT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS s FROM orders) SELECT k AS o_orderkey, (['', '0x', '0o', '0b', '1_'])[k % 5 + 1] || s AS text, CAST(CASE k % 5 WHEN 0 THEN k WHEN 4 THEN CAST('1' || s AS BIGINT)
        WHEN 1 THEN list_sum(list_transform(range(1, length(s) + 1), lambda i: CAST(s[i:i] AS BIGINT) * 16::BIGINT ** (length(s) - i)))
        WHEN 2 THEN CASE WHEN regexp_matches(s, '^[0-7]+$') THEN list_sum(list_transform(range(1, length(s) + 1), lambda i: CAST(s[i:i] AS BIGINT) * 8::BIGINT ** (length(s) - i))) END
        ELSE CASE WHEN regexp_matches(s, '^[01]+$') THEN list_sum(list_transform(range(1, length(s) + 1), lambda i: CAST(s[i:i] AS BIGINT) * 2::BIGINT ** (length(s) - i))) END END AS BIGINT) AS number FROM k""",
    "request_router": """WITH r AS (SELECT CASE WHEN event_id % 10 = 9 THEN 'Not a JSON object' WHEN event_id % 4 = 0 THEN 'Empty request id' WHEN event_type = 'click' OR event_type = 'purchase' THEN NULL WHEN event_type = 'view' THEN '"nothing" is not a valid command_id.' ELSE 'Invalid command_id' END AS failure,
        CASE WHEN event_type = 'click' THEN 'get_capabilities' WHEN event_type = 'purchase' THEN 'fix_code_in_file' END AS c FROM events) SELECT CASE WHEN failure IS NULL THEN c END AS command, failure, count(*) AS n FROM r GROUP BY 1, 2""",
}
