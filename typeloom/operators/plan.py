"""Patch plans: the patches of several packages applied to a set of tables, in load order.

A plan is a fold of DataFrames: each patch costs one join with its target, whatever its number of columns; long chains on one table are
cut every CUT patches. Problems - a target that is not there or not unique, a gate that is shut, a row that does not apply - are rows.
Names of tables and targets are compared by their last part without case; `package:name` asks for a table of that package.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .patch import Rule, bulk_patch, patch_problems, row_patch
from .stable import cut

CUT = 20
PROBLEM = "patch string, target string, key string, level string, message string"


@dataclass(frozen=True)
class Patch:
    """Rows of a keyed patch, or bulk rules, for one target. if_packages: all must be loaded, else the patch is passed over."""

    name: str
    target: str
    rows: DataFrame | None = None
    rules: tuple[Rule, ...] = ()
    order: int = 0
    package: str = ""
    if_packages: tuple[str, ...] = field(default_factory=tuple)


def base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].lower()


def resolve(target: str, tables: list[str], package_of: dict[str, str] | None = None) -> tuple[str | None, str]:
    """(table, remark) of a target: of several tables with the name the first by name, with a remark; none with the reason."""
    package, _, name = target.rpartition(":")
    found = sorted(t for t in tables if base_name(t) == base_name(name))
    if not found:
        return None, "no such table"
    if package:
        if package_of is None:
            return None, "packages are not known"
        found = [t for t in found if package_of.get(t, "").lower() == package.lower()]
        if not found:
            return None, f"not in package {package}"
    return found[0], f"one of {len(found)} tables of that name" if len(found) > 1 else ""


def in_order(patches: list[Patch], packages: list[str]) -> list[Patch]:
    """By package in load order, then the patch's own order, then name."""
    rank = {p: i for i, p in enumerate(packages)}
    return sorted(patches, key=lambda p: (rank.get(p.package, len(rank)), p.order, p.name))


def apply_plan(tables: dict[str, DataFrame], patches: list[Patch], packages: list[str] = (), package_of: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The tables after all patches, and what did not apply (PROBLEM rows; None for an empty plan)."""
    out, problems, applied, notes = dict(tables), None, {}, []
    for p in in_order(patches, list(packages)):
        if missing := [x for x in p.if_packages if x not in packages]:
            notes.append((p.name, p.target, None, "info", f"needs {', '.join(missing)}"))
            continue
        name, remark = resolve(p.target, list(out), package_of)
        if remark:
            notes.append((p.name, p.target, None, "warn" if name else "error", remark))
        if name is None:
            continue
        if p.rows is not None:
            bad = patch_problems(out[name], p.rows).select(F.lit(p.name).alias("patch"), F.lit(name).alias("target"), F.col("key").cast("string").alias("key"), "level", "message")
            problems = bad if problems is None else problems.unionByName(bad)
            out[name] = row_patch(out[name], p.rows)
        if p.rules:
            out[name] = bulk_patch(out[name], list(p.rules))
        applied[name] = applied.get(name, 0) + 1
        if applied[name] % CUT == 0:
            out[name] = cut(out[name])
    if notes:
        more = (next(iter(tables.values())).sparkSession if tables else SparkSession.active()).createDataFrame(notes, PROBLEM)
        problems = more if problems is None else problems.unionByName(more)
    return out, problems
