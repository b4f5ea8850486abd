"""A lattice of stored cuboids: each is made from its smallest parent, and a tile is answered from the smallest that covers it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import store
from .cube import CubeSpec, money
from .relational import union_sources

#: Measures that add up: what a cuboid holds of the facts. Counts add up too, under the name of COUNT.
SUMS, COUNT = ("value", "value_vnd", "quantity"), "trades"
#: Cuboids of the trade star, from the finest on. Levels of a hierarchy lie in one cuboid, as a lower level fixes the higher ones.
TIME = ("year", "quarter", "month", "time_key")
SHAPES = [
    (*TIME, "flow_type", "source_system", "chapter", "heading", "hs_code", "product_name", "continent", "region", "country_name"),
    (*TIME, "flow_type", "chapter", "heading", "hs_code", "product_name"),
    (*TIME, "flow_type", "source_system", "continent", "region", "country_name"),
    (*TIME, "flow_type", "chapter"),
    (*TIME, "flow_type", "source_system"),
    ("year", "flow_type"),
]


@dataclass(frozen=True)
class Cuboid:
    """A stored table of sums by columns, and how many rows it has."""

    columns: frozenset[str]
    rows: int
    table: DataFrame


def _summed(df: DataFrame, columns: list[str], counted: bool) -> DataFrame:
    sums = [F.sum(c).cast("decimal(38,2)").alias(c) for c in SUMS]
    return df.groupBy(*columns).agg(*sums, (F.sum(COUNT) if counted else F.count("*")).alias(COUNT))


def covering(cuboids: list[Cuboid], columns: set[str]) -> Cuboid | None:
    """The smallest cuboid that has all the columns."""
    return min((c for c in cuboids if columns <= c.columns), key=lambda c: (c.rows, len(c.columns)), default=None)


def build(facts: DataFrame, shapes: list[tuple[str, ...]] = SHAPES) -> list[Cuboid]:
    """Cuboids of the shapes over facts (with the columns and SUMS): those of the most columns first, each from the smallest one
    before it that covers it, or else from the facts."""
    out: list[Cuboid] = []
    for shape in sorted(shapes, key=len, reverse=True):
        parent = covering(out, set(shape))
        made = _summed(parent.table if parent else facts, list(shape), parent is not None)
        table = facts.sparkSession.read.schema(made.schema).parquet(store(made, "cuboid"))
        out.append(Cuboid(frozenset(shape), table.count(), table))
    return out


def build_by_keys(fact: DataFrame, dims: dict[str, tuple[DataFrame, str]], shapes: list[tuple[str, ...]] = SHAPES) -> list[Cuboid]:
    """build() over the join of a stored fact with dims (the fact's key: its table, and the column of its lowest level), without
    the texts of dimensions in groups: a cuboid with a lowest level is summed and stored by the dimension's key, and gets the
    other columns when it is read. The fact itself is the finest one, of which every row counts once, and is not stored again.
    Facts without a row in each of the dims do not show."""
    spark, tables = fact.sparkSession, {k: t for k, (t, _) in dims.items()}
    level = {k: lowest for k, (_, lowest) in dims.items()}
    rows = fact.withColumn(COUNT, F.lit(1).cast("long"))
    for key, table in tables.items():
        rows = rows.join(table.select(key), key, "left_semi")

    def shown(stored: DataFrame, keys: list[str], columns: tuple[str, ...] | list[str]) -> DataFrame:
        for k in keys:
            stored = stored.join(tables[k], k)
        return stored.select(*columns, *SUMS, COUNT)

    plain = [c for c in fact.columns if c not in (*SUMS, *tables)]
    every = list(dict.fromkeys([*plain, *[c for t in tables.values() for c in t.columns]]))
    # of each cuboid: what it is stored as, and the keys in it
    held = {frozenset(every): (rows, list(tables))}
    out = [Cuboid(frozenset(every), fact.count(), shown(rows, list(tables), every))]
    for shape in sorted(shapes, key=len, reverse=True):
        keys = [k for k in tables if level[k] in shape]
        fixed = {c for k in keys for c in tables[k].columns}
        groups = [*keys, *[c for c in shape if c not in fixed]]
        if set(tables) <= set(keys):
            continue  # no coarser than the fact
        parent = covering(out, set(shape) | set(keys)) or covering(out, set(shape))
        stored, within = held[parent.columns]
        for k in within:
            if k not in keys and set(groups) & set(tables[k].columns):
                stored = stored.join(tables[k], k)
        made = _summed(stored, groups, True)
        table = spark.read.schema(made.schema).parquet(store(made, "cuboid"))
        columns = list(dict.fromkeys([*shape, *keys]))
        held[frozenset(columns)] = (table, keys)
        out.append(Cuboid(frozenset(columns), table.count(), shown(table, keys, columns)))
    return out


def stored_measures() -> CubeSpec:
    """The trade cube's measures over cuboids."""
    vnd = F.col("value_vnd")
    flows = {"export_vnd": F.sum(F.when(F.col("flow_type"), vnd)).cast("double"), "import_vnd": F.sum(F.when(~F.col("flow_type"), vnd)).cast("double")}
    surplus = F.coalesce("export_vnd", F.lit(0.0)) - F.coalesce("import_vnd", F.lit(0.0))
    return CubeSpec({**{c: money(c) for c in SUMS}, COUNT: F.sum(COUNT), **flows}, {"surplus": surplus, "asymmetry": F.abs(F.col("surplus")) / F.nullif(F.col("value_vnd"), F.lit(0.0))})


def members(only: dict[str, list] | None = None, without: dict[str, list] | None = None) -> Column:
    """Members of dimensions that a view keeps, and those that it leaves out; a null is a member too."""
    keep = F.lit(True)
    for chosen, wanted in ((only or {}, True), (without or {}, False)):
        for column, values in chosen.items():
            known = [v for v in values if v is not None]
            inside = F.coalesce(F.col(column).isin(known), F.lit(False)) if known else F.lit(False)
            if None in values:
                inside = inside | F.col(column).isNull()
            keep = keep & (inside if wanted else ~inside)
    return keep


def view(cuboids: list[Cuboid], rows: list[str], wanted: list[str], only: dict[str, list] | None = None, without: dict[str, list] | None = None) -> DataFrame:
    """Any tile: the wanted measures by the members of rows, over the members of other dimensions that only and without leave.
    Answered from the smallest cuboid that has the columns of rows, filters and, for measures by flow, the flow."""
    spec = stored_measures()
    by_flow = {"flow_type"} if {"export_vnd", "import_vnd", *spec.calculated} & set(wanted) else set()
    needed = {*rows, *(only or {}), *(without or {}), *by_flow}
    found = covering(cuboids, needed)
    if found is None:
        raise ValueError(f"no cuboid has {sorted(needed)}")
    out = found.table.where(members(only, without)).groupBy(*rows).agg(*[m.alias(n) for n, m in spec.measures.items() if by_flow or n not in ("export_vnd", "import_vnd")])
    for n, c in spec.calculated.items() if by_flow else ():
        out = out.withColumn(n, c)
    return out.select(*rows, *wanted)


def cube(facts: DataFrame, dims: list[str], wanted: list[str]) -> DataFrame:
    """All combinations of dims, each with an All member (shown as grouped_<dim> = 1): facts are read once, for the finest, and
    every other combination comes from its smallest parent."""
    shapes = [s for n in range(len(dims), 0, -1) for s in combinations(dims, n)]
    held = build(facts, shapes)
    total = _summed(min(held, key=lambda c: c.rows).table, [], True).where(f"{COUNT} is not null")
    schema = {f.name: f.dataType for f in held[0].table.schema.fields}
    parts = []
    for table, columns in [*((c.table, c.columns) for c in held), (total, frozenset())]:
        names = [(F.col(d) if d in columns else F.lit(None).cast(schema[d])).alias(d) for d in dims]
        parts.append(table.select(*names, *[F.lit(int(d not in columns)).alias(f"grouped_{d}") for d in dims], *[F.col(m).cast("bigint" if m == COUNT else "double").alias(m) for m in wanted]))
    return union_sources(*parts)
