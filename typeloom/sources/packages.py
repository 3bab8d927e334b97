"""Checks and edits of package catalogs. A catalog is a table with a row for each file (path, and what it declares); manifests are
a table with a row for each package. All are DataFrames in and out: problems are rows (subject, problem), as in validation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.strings import did_you_mean, parse_version, version_satisfies
from typeloom.operators.relational import numbered

PROBLEM = "subject string, problem string"


def _problems(df: DataFrame, subject: Column | str, problem: Column | str) -> DataFrame:
    return df.select(F.col(subject).cast("string").alias("subject") if isinstance(subject, str) else subject.alias("subject"), F.lit(problem).alias("problem") if isinstance(problem, str) else problem.alias("problem"))


# -- edits of a catalog --


def set_entry(catalog: DataFrame, path: str, column: str, value) -> DataFrame:
    """A declared value of one file replaced (its path, supertype, load order or type name)."""
    if column not in catalog.columns:
        raise ValueError(f"no column {column}")
    return catalog.withColumn(column, F.when(F.lower("path") == path.lower(), F.lit(value).cast(catalog.schema[column].dataType)).otherwise(F.col(column)))


def remove_entry(catalog: DataFrame, path: str) -> DataFrame:
    return catalog.where(~F.coalesce(F.lower("path") == path.lower(), F.lit(False)))


# -- joins of files --


def join_groups(catalog: DataFrame) -> DataFrame:
    """primary, secondaries (sorted paths) from catalog (path, join_into)."""
    rows = catalog.where(F.coalesce("join_into", F.lit("")) != "")
    return rows.groupBy(F.lower("join_into").alias("primary")).agg(F.array_sort(F.collect_set(F.lower("path"))).alias("secondaries"))


def resolve_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """name, path of wanted (name): the file whose lower-cased path is the name or ends in "/" and the name; of several the shortest, then first.

    Each path is looked up by all its suffixes, so this is an equi-join."""
    parts = F.split(F.lower("path"), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    index = files.select("path", F.explode(suffixes).alias("suffix"))
    best = wanted.select("name").distinct().join(index, F.lower("name") == F.col("suffix"))
    found = best.groupBy("name").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("m")).select("name", "m.path")
    return wanted.join(found, "name", "left")


def exported(catalog: DataFrame) -> DataFrame:
    """Files that are written: by their own flag `export`, which defaults to false for a file joined into another and to true for others."""
    joined = F.coalesce("join_into", F.lit("")) != ""
    return catalog.where(F.coalesce(F.col("export"), ~joined))


def join_target_problems(catalog: DataFrame) -> DataFrame:
    """Joins into a file that is not there, into itself, or into one that is joined itself."""
    files = catalog.select(F.lower("path").alias("_p"), (F.coalesce("join_into", F.lit("")) != "").alias("_chained")).hint("merge")  # as long as the catalog: small files hold large tables
    both = catalog.where(F.coalesce("join_into", F.lit("")) != "").join(files, F.lower("join_into") == F.col("_p"), "left")
    problem = F.when(F.col("_p").isNull(), "joins into an unknown file").when(F.lower("path") == F.lower("join_into"), "joins into itself").when(F.col("_chained"), "joins into a joined file")
    return _problems(both.where(problem.isNotNull()), "path", problem)


# -- packages --


def dependency_problems(manifests: DataFrame) -> DataFrame:
    """Unmet dependencies, versions that do not satisfy, and conflicts among manifests (id, version, dependencies array<struct<id, op, version>>, conflicts array<string>)."""
    known = manifests.select(F.col("id").alias("_id"), F.col("version").alias("_version"))
    wanted = manifests.select("id", F.explode("dependencies").alias("d")).select("id", F.col("d.id").alias("on"), F.col("d.op").alias("op"), F.col("d.version").alias("need")).join(known, F.col("on") == F.col("_id"), "left")
    have, need = parse_version(F.col("_version")), parse_version(F.col("need"))
    ok = F.lit(False)
    for op in ("=", "==", ">", ">=", "<", "<=", "~", "^"):
        ok = F.when(F.col("op") == op, version_satisfies(op, need, have)).otherwise(ok)
    bad = F.when(F.col("_id").isNull(), F.concat(F.lit("needs "), "on")).when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("needs "), "on", F.lit(" "), "op", F.lit(" "), "need"))
    first = _problems(wanted.where(bad.isNotNull()), "id", bad)
    clash = manifests.select("id", F.explode("conflicts").alias("with")).join(known.select(F.col("_id").alias("with")), "with", "left_semi")
    return first.unionByName(_problems(clash, "id", F.concat(F.lit("conflicts with "), "with")))


def overlap_problems(packages: DataFrame) -> DataFrame:
    """Packages (id, path) inside another one's path: each path is looked up by its proper ancestors."""
    parts = F.split(F.lower(F.regexp_replace("path", "/+\\z", "")), "/")
    own = packages.select(F.array_join(parts, "/").alias("_outer"), F.col("id").alias("_outer_id"))
    up = packages.select("id", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).alias("_outer"))
    return _problems(up.join(own, "_outer"), "id", F.concat(F.lit("lies inside "), "_outer_id"))


def owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """files (path) with package: the package (id, path) whose path is the longest ancestor of the file, of several with that path the last by id; null without one."""
    parts = F.split(F.lower("path"), "/")
    up = files.select(F.col("path").alias("_file"), F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).alias("_at")).distinct()
    at = packages.select(F.lower(F.regexp_replace("path", "/+\\z", "")).alias("_at"), F.col("id").alias("package"))
    best = up.join(at, "_at").groupBy("_file").agg(F.max(F.struct(F.length("_at").alias("n"), "package")).alias("m")).select("_file", "m.package")
    return files.join(best, files["path"] == best["_file"], "left").drop("_file")


def variant_choices(groups: DataFrame, chosen: list[str]) -> DataFrame:
    """group, variant of groups (group, variant, is_default): the one chosen, or the default; null where there is not exactly one."""
    picked = F.col("variant").isin(chosen or [""])
    per = groups.groupBy("group").agg(F.array_sort(F.collect_set(F.when(picked, F.col("variant")))).alias("own"), F.array_sort(F.collect_set(F.when(F.col("is_default"), F.col("variant")))).alias("default"))
    one = F.when(F.size("own") == 1, F.element_at("own", 1)).when((F.size("own") == 0) & (F.size("default") == 1), F.element_at("default", 1))
    return per.select("group", one.alias("variant"))


def unknown_names(used: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Values of a column that are none of the known ones, with a suggestion: gates and variants that nobody declares."""
    bad = used.select(column).where(F.col(column).isNotNull() & ~F.col(column).isin(known or [""])).distinct()
    return _problems(bad, column, F.concat(F.lit("unknown"), did_you_mean(F.col(column), known)))


def undeclared(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Data files (path) that no catalog row declares: they are reported and not loaded."""
    declared = catalog.select(F.lower("path").alias("_p")).distinct()
    return _problems(files.join(declared, F.lower("path") == F.col("_p"), "left_anti"), "path", "not declared")


def breadth_first(files: DataFrame) -> DataFrame:
    """files (path) with place: fewest separators first, then by name."""
    depth = F.length("path") - F.length(F.replace("path", F.lit("/")))
    return numbered(files.withColumn("_depth", depth), ["_depth", "path"], "place").drop("_depth")


# -- processors and validators over several tables --


def run_processors(tables: dict, processors: list[tuple], owned: set[str] | None = None) -> tuple[dict, list[tuple[str, str]]]:
    """Tables after processors (name, priority, table, function DataFrame -> DataFrame), by priority, then as declared.

    One that raises while its plan is made leaves its table as it was and is reported; so is one that writes a table not owned."""
    out, problems = dict(tables), []
    for name, _, table, f in sorted(processors, key=lambda p: p[1]):
        if table not in out or owned is not None and table not in owned:
            problems.append((name, f"may not write {table}"))
            continue
        try:
            out[table] = f(out[table])
        except Exception as e:  # noqa: BLE001 - a processor's own error is a finding
            problems.append((name, str(e).splitlines()[0]))
    return out, problems


def package_violations(tables: dict, validators: list[tuple], source: str = "") -> DataFrame:
    """Violations of checks over several tables: (name, function of the tables -> one-row DataFrame with a column verdict, level, message)."""
    from typeloom.operators.validate import verdict_message

    out = None
    for name, f, level, message in validators:
        one = f(tables)
        m = verdict_message(F.col("verdict"), one.schema["verdict"].dataType, message)
        null = F.lit(None).cast("string")
        rows = one.select(F.lit(source).alias("source"), null.cast("long").alias("line"), null.alias("pk"), F.lit(name).alias("column"), null.alias("value"), null.alias("type"), F.lit(level).alias("level"), m.alias("message")).where("message is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def match_results(asked: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """asked (key, _pos) with the result columns of results (key, _pos, ...): by trimmed name without case, else by position; of several results at one position the least counts."""
    rest = [c for c in results.columns if c not in (key, "_pos")]
    clean = lambda c: F.lower(F.btrim(c))
    named = results.groupBy(clean(F.col(key)).alias("_k")).agg(F.min_by(F.struct(*rest), "_pos").alias("named"))
    placed = results.groupBy(F.col("_pos").alias("_p")).agg(F.min(F.struct(*rest)).alias("placed"))
    both = asked.join(named, clean(F.col(key)) == F.col("_k"), "left").join(placed, F.col("_pos") == F.col("_p"), "left")
    return both.select(*asked.columns, F.coalesce("named", "placed").alias("_r")).select(*asked.columns, "_r.*")
