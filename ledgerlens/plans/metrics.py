"""Registry of named metrics and derived series over the long table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Registry:
    """Metrics are aggregate expressions; derived series are functions of other series, resolved by name."""

    def __init__(self) -> None:
        self.metrics: dict[str, Callable[..., Column]] = {}
        self.derived: dict[str, tuple[list[str], Callable[..., DataFrame]]] = {}

    def add_metric(self, name: str, make: Callable[..., Column]) -> None:
        self.metrics[name] = make

    def remove_metric(self, name: str) -> None:
        del self.metrics[name]

    def evaluate(self, df: DataFrame, keys: list[str], params: dict[str, dict] | None = None) -> DataFrame:
        """All metrics of each series, in one aggregate."""
        return df.groupBy(*keys).agg(*[make(**(params or {}).get(name, {})).alias(name) for name, make in self.metrics.items()])

    def evaluate_multi(self, df: DataFrame, inputs: list, key: str, metric: Callable[[list[Column]], Column], name: str) -> DataFrame:
        """A metric over several named series."""
        picked = [F.when(F.col(key) == x, F.col("value")) for x in inputs]
        return df.where(F.col(key).isin(inputs)).agg(metric(picked).alias(name))

    def add_series(self, name: str, inputs: list[str], make: Callable[..., DataFrame]) -> None:
        self.derived[name] = (inputs, make)

    def resolve(self, name: str, sources: dict[str, DataFrame], trail: tuple[str, ...] = ()) -> DataFrame:
        """A derived series, its inputs resolved first; a cycle is an error."""
        if name in sources:
            return sources[name]
        if name in trail:
            raise ValueError(f"cycle: {' -> '.join((*trail, name))}")
        inputs, make = self.derived[name]
        return make(*[self.resolve(x, sources, (*trail, name)) for x in inputs])


class Graph:
    """Derived series and features of one table, worked out together.

    A node is a function of other nodes; an input may be named ``node::transform``, for any node and transform. Nodes are columns
    over (series_id, t_ms), each made once however many others use it, so the table is read once and sorted once. Features
    that are installed are appended to what is asked for, and everything comes back as one long table.
    """

    def __init__(self, base: str = "base"):
        self.base, self.nodes, self.transforms, self.installed = base, {}, {}, []

    def transform(self, name: str, make: Callable[[Column], Column]) -> None:
        self.transforms[name] = make

    def add(self, name: str, inputs: list[str], make: Callable[..., Column]) -> None:
        if name in self.nodes or name == self.base:
            raise ValueError(f"{name} is there already")
        self.nodes[name] = (inputs, make)

    def install(self, *names: str) -> None:
        """Features that every analysis gets, one name or set after the other; each counts once."""
        self.installed += [n for n in names if n not in self.installed]

    def remove(self, name: str) -> None:
        self.installed.remove(name)

    def _need(self, name: str, made: list[str], trail: tuple[str, ...]) -> None:
        if name in made or name == self.base:
            return
        if name in trail:
            raise ValueError(f"cycle: {' -> '.join((*trail, name))}")
        for x in self._parts(name)[0]:
            self._need(x, made, (*trail, name))
        made.append(name)

    def _parts(self, name: str) -> tuple[list[str], Callable[..., Column]]:
        if name in self.nodes:
            return self.nodes[name]
        source, _, how = name.rpartition("::")
        if not source or how not in self.transforms:
            raise KeyError(f"no series or transform for {name}")
        return [source], self.transforms[how]

    def evaluate(self, df: DataFrame, wanted: list[str], key: str = "series_id") -> DataFrame:
        """(key, item, t_ms, value) of the wanted and the installed nodes; missing values are left out."""
        wanted = list(dict.fromkeys([*wanted, *self.installed]))
        made: list[str] = []
        for name in wanted:
            self._need(name, made, ())
        column = {self.base: "_n", **{name: f"_n{i}" for i, name in enumerate(made)}}
        wide = df.select(key, "t_ms", F.col("value").alias("_n"))
        for name in made:
            inputs, make = self._parts(name)
            wide = wide.withColumn(column[name], make(*[F.col(column[x]) for x in inputs]))
        items = F.array(*[F.struct(F.lit(n).alias("item"), F.col(column[n]).alias("value")) for n in wanted])
        return wide.select(key, "t_ms", F.explode(items).alias("x")).select(key, "x.item", "t_ms", "x.value").where("value IS NOT NULL AND NOT isnan(value)")


def before(x: Column, n: int = 1, key: str = "series_id") -> Column:
    """The value n ticks earlier."""
    return F.lag(x, n).over(W.partitionBy(key).orderBy("t_ms"))


def return_graph() -> Graph:
    """Transforms and the default features: log and simple returns of the base series."""
    g = Graph()
    g.transform("double", lambda x: x * 2)
    g.transform("diff", lambda x: x - before(x))
    g.transform("log", lambda x: F.when((before(x) > 0) & (x > 0), F.ln(x / before(x))))
    g.transform("simple", lambda x: F.when((before(x) > 0) & (x >= 0), (x - before(x)) / before(x)))
    g.install("base::log", "base::simple")
    return g
