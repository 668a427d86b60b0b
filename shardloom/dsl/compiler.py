"""Expressions of the boolean language compiled to columns over a pool.

A pool has one row per shard_id and the columns of ``pool_columns``. Set
algebra over ids is the same as logic per row, provided no predicate is null;
so every primitive is made false where it would be null. Ranks are added to the
pool once, whatever the number of primitives that use them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..operators.ranking import global_rank, top_share
from .parser import Node, QueryError, parse

#: Columns a pool has to have.
POOL_COLUMNS = ("shard_id", "source", "light_decision", "light_score", "final_value_score", "training_loss_normalized", "aesthetic_avg", "caption_quality", "diversity_score", "has_unified")
SCORES = ("light_score", "final_value_score", "training_loss_normalized", "aesthetic_avg", "caption_quality", "diversity_score")


@dataclass(frozen=True)
class Primitive:
    """``make(args, resolve)`` gives the column; ``needs`` names the rank it uses."""

    make: Callable[[tuple, Callable[[str], Column]], Column]
    needs: str | None = None
    arguments: tuple[int, int] = (0, 0)


def _score(name: str) -> Column:
    return F.col(name)


def _number(args: tuple, default: float) -> float:
    if args and not isinstance(args[0], float):
        raise QueryError(f"{args[0]!r} is no number")
    return args[0] if args else default


def _at_least(column: str, default: float, missing: float | None = None) -> Primitive:
    def make(args: tuple, _) -> Column:
        value = _score(column) if missing is None else F.coalesce(_score(column), F.lit(missing))
        return value >= F.lit(_number(args, default))

    return Primitive(make, arguments=(0, 1))


def _rank_share(needs: str, default: float, fallback: Callable[[], Column] | None = None) -> Primitive:
    def make(args: tuple, _) -> Column:
        inside = top_share(F.col(f"{needs}_rank"), F.col(f"{needs}_total"), _number(args, default))
        return inside if fallback is None else F.when(fallback(), F.lit(True)).otherwise(inside)

    return Primitive(make, needs, (0, 1))


def _source(args: tuple, _) -> Column:
    return F.lower("source") == F.lit(str(args[0]).lower())


def _none_scored() -> Column:
    """Whether no row of the pool has a diversity score (its count comes with the rank)."""
    return F.coalesce(F.col("diversity_all"), F.lit(0)) == 0


#: What a rank orders by, from the greatest.
RANKS: dict[str, Callable[[], Column]] = {
    "value": lambda: F.when(_score("final_value_score") > 0, _score("final_value_score")),
    "hard": lambda: F.coalesce(_score("training_loss_normalized"), 1.0 - F.coalesce(_score("light_score"), F.lit(0.0))),
    "diversity": lambda: _score("diversity_score"),
}

PRIMITIVES: dict[str, Primitive] = {
    "all": Primitive(lambda args, _: F.lit(True)),
    "keep": Primitive(lambda args, _: F.coalesce("light_decision", F.lit("keep")) != "discard"),
    "all_unified": Primitive(lambda args, _: F.coalesce(F.col("has_unified"), F.lit(0)) != 0),
    "top_pct": _rank_share("value", 80.0),
    "top_n": Primitive(lambda args, _: F.col("value_rank") <= F.lit(int(_number(args, 100.0))), "value", (0, 1)),
    "min_score": _at_least("final_value_score", 0.5),
    "min_light": _at_least("light_score", 0.5),
    "min_loss": _at_least("training_loss_normalized", 0.5),
    "min_aesthetic": _at_least("aesthetic_avg", 0.5, 0.0),
    "min_diversity": _at_least("diversity_score", 0.5, 0.0),
    "min_caption": _at_least("caption_quality", 0.45, 0.0),
    "low_caption": Primitive(lambda args, _: F.coalesce(_score("caption_quality"), F.lit(0.0)) < F.lit(_number(args, 0.45)), arguments=(0, 1)),
    "hard_focus": _rank_share("hard", 50.0),
    "hard_mining_focus": _rank_share("hard", 50.0),
    "high_diversity": _rank_share("diversity", 50.0, _none_scored),
    "source": Primitive(_source, arguments=(1, 1)),
    "src": Primitive(_source, arguments=(1, 1)),
    "campaign": Primitive(lambda args, resolve: resolve(str(args[0])), arguments=(1, 1)),
}


def references(node: Node) -> set[str]:
    """Names of stored selections that an expression refers to."""
    if node.kind == "call":
        return {str(a) for a in node.args} if node.name == "campaign" else set()
    if node.kind == "name":
        return set() if node.name in PRIMITIVES or node.name.startswith(("source:", "src:")) else {node.name}
    return set().union(*(references(c) for c in node.children))


def validate(text: str, stored: set[str] = frozenset()) -> list[str]:
    """What is wrong with an expression, without running it; empty if nothing."""
    try:
        tree = parse(text)
    except QueryError as e:
        return [str(e)]
    found: list[str] = []

    def walk(n: Node) -> None:
        if n.kind == "call":
            p = PRIMITIVES.get(n.name)
            if p is None:
                found.append(f"unknown function {n.name}")
            elif not p.arguments[0] <= len(n.args) <= p.arguments[1]:
                found.append(f"{n.name} takes {p.arguments[0]} to {p.arguments[1]} arguments")
        for c in n.children:
            walk(c)

    walk(tree)
    return found + [f"unknown selection {r}" for r in sorted(references(tree) - set(stored))]


def _needs(node: Node) -> set[str]:
    own = set()
    if node.kind in ("call", "name") and node.name in PRIMITIVES and PRIMITIVES[node.name].needs:
        own = {PRIMITIVES[node.name].needs}
    return own.union(*(_needs(c) for c in node.children)) if node.children else own


def evaluate(pool: DataFrame, text: str, stored: dict[str, DataFrame] | None = None, flag: str = "included") -> DataFrame:
    """The pool with a boolean column that says which rows the expression selects; never null.

    ``stored`` has selections by name, each with shard_id and decision. Null
    and NaN scores are missing. Raises QueryError for unknown names.
    """
    stored = stored or {}
    wrong = validate(text, set(stored))
    if wrong:
        raise QueryError("; ".join(wrong))
    tree = parse(text)
    out = pool
    for s in SCORES:
        out = out.withColumn(s, finite(F.col(s)))
    added: list[str] = []
    for name in sorted(_needs(tree)):
        out = global_rank(out, RANKS[name](), "shard_id", f"{name}_rank", f"{name}_total")
        added += [f"{name}_rank", f"{name}_total"]
        if name == "diversity":
            scored = out.where("diversity_score IS NOT NULL").limit(1).count()
            out = out.withColumn("diversity_all", F.lit(scored))
            added.append("diversity_all")
    marks: dict[str, str] = {}
    for i, name in enumerate(sorted(references(tree))):
        marks[name] = f"__in{i}"
        ids = stored[name].where("decision = 'include'").select("shard_id").distinct().withColumn(marks[name], F.lit(True))
        out = out.join(ids, "shard_id", "left")
        added.append(marks[name])

    def column(n: Node) -> Column:
        if n.kind == "or":
            parts = [column(c) for c in n.children]
            return _fold(parts, lambda a, b: a | b)
        if n.kind == "and":
            return _fold([column(c) for c in n.children], lambda a, b: a & b)
        if n.kind == "not":
            return ~column(n.children[0])
        if n.kind == "name" and n.name.startswith(("source:", "src:")):
            made = _source((n.name.split(":", 1)[1],), None)
        elif n.name in PRIMITIVES:
            made = PRIMITIVES[n.name].make(n.args, lambda r: F.col(marks[r]))
        else:
            made = F.col(marks[n.name])
        return F.coalesce(made, F.lit(False))

    return out.withColumn(flag, column(tree)).drop(*added)


def _fold(parts: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = join(out, p)
    return out


def decide(selected: DataFrame, include: list[str] = (), exclude: list[str] = (), floor: float | None = None, base: DataFrame | None = None, flag: str = "included") -> DataFrame:
    """``shard_id, decision`` of a selection after overrides.

    Ids outside ``base`` (those it includes) are excluded, then the floor of
    final_value_score applies, then forced exclusion, then forced inclusion,
    which neither floor nor base undoes. ``include`` and ``exclude`` are lists
    an operator writes by hand.
    """
    on = F.col(flag)
    out = selected
    if base is not None:
        ids = base.where("decision = 'include'").select("shard_id").distinct().withColumn("__base", F.lit(True))
        out = out.join(ids, "shard_id", "left")
        on = on & F.coalesce("__base", F.lit(False))
    if floor is not None:
        on = on & (F.coalesce("final_value_score", F.lit(0.0)) >= floor)
    on = F.when(F.col("shard_id").isin(list(include)), F.lit(True)).when(F.col("shard_id").isin(list(exclude)), F.lit(False)).otherwise(on)
    return out.select("shard_id", F.when(on, F.lit("include")).otherwise(F.lit("exclude")).alias("decision"))
