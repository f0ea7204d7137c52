"""Networks as pairs of lazy DataFrames, with small catalogs for groups, contexts and organisms."""

from __future__ import annotations

import random
import string
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples a second of every recording.
F_SAMPLE = 5
CHEMICAL, GAP = "chemical-synapse", "gap-junction"
NEURONS = "name string, type string, category string, modality string, position struct<AP:double,LR:double,DV:double>, props map<string,string>"
CONNECTIONS = "pre string, post string, uid int, connection_type string, weight double, color string, props map<string,string>"


@dataclass(frozen=True)
class Network:
    """A directed multigraph: ``neurons`` has at least ``name``, ``connections`` at least pre, post, connection_type, weight.

    Immutable: operators return new networks over new plans, so a filtered network is a view of the one that it comes from.
    """

    name: str
    neurons: DataFrame
    connections: DataFrame
    groups: dict[str, DataFrame] = field(default_factory=dict)

    def with_(self, **changes) -> Network:
        return replace(self, **changes)

    def copy(self, name: str, kind: str = "deep") -> Network:
        """A copy under another name. DataFrames can't change, so all kinds but ``deep_without_data`` are the same."""
        if kind not in ("shallow", "deep", "deep_with_data", "deep_without_data"):
            raise ValueError(f"unknown copy type {kind!r}")
        if kind == "deep_without_data":
            return Network(name, self.neurons.select("name"), self.connections.select("pre", "post", "connection_type", "weight"))
        return replace(self, name=name)

    # Groups: a registry of member tables.

    def make_neuron_group(self, name: str, members: Iterable[str] | DataFrame) -> Network:
        if name in self.groups:
            raise ValueError(f"there is a group {name!r}")
        if not isinstance(members, DataFrame):
            members = self.neurons.sparkSession.createDataFrame([(m,) for m in members], "name string")
        return replace(self, groups={**self.groups, name: self.neurons.join(members.select("name").distinct(), "name", "left_semi")})

    def make_connection_group(self, name: str, condition: Column) -> Network:
        if name in self.groups:
            raise ValueError(f"there is a group {name!r}")
        return replace(self, groups={**self.groups, name: self.connections.where(condition)})

    def group(self, name: str) -> DataFrame:
        """A group's members; KeyError if there is none of the name."""
        return self.groups[name]

    def _keys(self, name: str) -> list[str]:
        return ["name"] if "name" in self.group(name).columns else [c for c in ("pre", "post", "uid", "connection_type") if c in self.group(name).columns]

    def _rows(self, name: str, members: DataFrame | Iterable) -> DataFrame:
        """Members as a table of the group's keys: names, or tuples of (pre, post) and what else tells parallel edges apart."""
        if isinstance(members, DataFrame):
            return members.select(*[c for c in self._keys(name) if c in members.columns]).distinct()
        rows = [m if isinstance(m, tuple) else (m,) for m in members]
        kinds = dict(self.group(name).dtypes)
        keys = self._keys(name)[: len(rows[0]) if rows else None]
        return self.neurons.sparkSession.createDataFrame(rows, ", ".join(f"{k} {kinds[k]}" for k in keys)).distinct()

    def _with_group(self, name: str, members: DataFrame) -> Network:
        return replace(self, groups={**self.groups, name: members})

    def add_to_group(self, name: str, members: DataFrame | Iterable) -> Network:
        """Members of the network join a group; those that are in it already stay once, and others aren't added."""
        rows, keys = self._rows(name, members), self._keys(name)
        whole = self.neurons if keys == ["name"] else self.connections
        new = whole.join(rows, rows.columns, "left_semi").join(self.group(name).select(*keys), keys, "left_anti")
        return self._with_group(name, self.group(name).unionByName(new, allowMissingColumns=True))

    def remove_from_group(self, name: str, members: DataFrame | Iterable) -> Network:
        """Members leave a group; those that aren't in it are passed over."""
        rows = self._rows(name, members)
        return self._with_group(name, self.group(name).join(rows, rows.columns, "left_anti"))

    def pop_from_group(self, name: str, member: str | tuple) -> Network:
        """One member leaves a group; KeyError if it isn't in it."""
        if not self.in_group(name, member):
            raise KeyError(member)
        return self.remove_from_group(name, [member])

    def clear_group(self, name: str) -> Network:
        return self._with_group(name, self.group(name).limit(0))

    def in_group(self, name: str, member: str | tuple) -> bool:
        rows = self._rows(name, [member])
        return not self.group(name).join(rows, rows.columns, "left_semi").isEmpty()

    def group_size(self, name: str) -> int:
        return self.group(name).count()

    def set_group_property(self, name: str, key: str, value) -> Network:
        """Sets an attribute of all members of a group, in the network and in the group."""
        keys = self._keys(name)
        marks = self.group(name).select(*keys).distinct().withColumn("_in", F.lit(True))

        def changed(df: DataFrame) -> DataFrame:
            old = F.col(key) if key in df.columns else F.lit(None)
            return df.join(marks, keys, "left").withColumn(key, F.when(F.col("_in"), F.lit(value)).otherwise(old)).drop("_in")

        side = "neurons" if keys == ["name"] else "connections"
        return replace(self._with_group(name, self.group(name).withColumn(key, F.lit(value))), **{side: changed(getattr(self, side))})

    def delete_group(self, name: str) -> Network:
        return replace(self, groups={k: v for k, v in self.groups.items() if k != name})

    @property
    def num_groups(self) -> int:
        """All neurons and all connections count as groups, too."""
        return len(self.groups) + 2


def signature_dict(prefix: str, parameters: dict[str, object]) -> dict[str, str]:
    """Parameters of a context that identify it: without private names, name and description."""
    return {f"{prefix}:{k}": str(v) for k, v in sorted(parameters.items()) if not k.startswith("_") and k not in ("name", "description")}


def signature(parameters: Column, prefix: Column) -> Column:
    """The same as one string, of a map column: entries sorted by key."""
    entries = F.filter(F.map_entries(parameters), lambda e: ~e["key"].startswith("_") & ~e["key"].isin("name", "description"))
    return F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(prefix, F.lit(":"), e["key"], F.lit("="), e["value"]))), "_")


#: Stage, sex and genotype that an organism has by default.
DEFAULTS = {"worm": ("Day-1 Adult", "Hermaphrodite", "N2"), "fly": ("Day-7 Adult", "Female", "w1118 x Canton-S G1")}


@dataclass
class Organism:
    """An animal with its networks and contexts; of the contexts at most one is active."""

    species: str
    name: str = ""
    stage: str = ""
    sex: str = ""
    genotype: str = ""
    networks: dict[str, Network] = field(default_factory=dict)
    contexts: dict[str, dict] = field(default_factory=dict)
    active: str | None = None
    props: dict[str, object] = field(default_factory=dict)

    def __post_init__(self):
        stage, sex, genotype = DEFAULTS.get(self.species, ("", "", ""))
        self.stage, self.sex, self.genotype = self.stage or stage, self.sex or sex, self.genotype or genotype
        self.name = self.name or f"{self.species.capitalize()}-{random_string(8)}"

    def add_context(self, name: str, parameters: dict) -> None:
        self.contexts[name] = parameters

    def remove_context(self, name: str) -> None:
        if name not in self.contexts:
            raise ValueError(f"no context {name!r}")
        del self.contexts[name]
        self.active = None if self.active == name else self.active

    def get_context(self, name: str) -> dict | None:
        return self.contexts.get(name)

    def set_active_context(self, name: str) -> None:
        if name not in self.contexts:
            raise ValueError(f"no context {name!r}")
        self.active = name

    def clear_active_context(self) -> None:
        self.active = None


def random_string(n: int = 8) -> str:
    return "".join(random.choices(string.ascii_letters + string.digits, k=n))


def empty(spark: SparkSession, name: str) -> Network:
    return Network(name, spark.createDataFrame([], NEURONS), spark.createDataFrame([], CONNECTIONS))
