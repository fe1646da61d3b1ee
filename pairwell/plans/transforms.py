"""A plan: ordered, reversible changes of an external contract, compiled to native expressions over leaves.

forward() gives the contract that a model sees; inverse() turns the leaves of its output back. Output that
does not satisfy the internal contract, cannot be reversed, or fails the external contract yields a typed
error code and no value: a partial result never comes out. Steps name keys as they stand in paths (jsontext.pointer).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions.contracts import CANONICAL_SEARCH, Field, conforms, is_canonical_integer, key_order


@dataclass(frozen=True)
class IntegerString:
    """The external integer string at path is an integer inside."""

    path: str
    rank = 40

    def forward(self, contract: list[Field]) -> list[Field]:
        at = [f for f in contract if f.path == self.path]
        if not at or at[0].pattern != CANONICAL_SEARCH:
            raise ValueError(f"{self.path}: not a canonical integer string")
        return [replace(f, type="integer", pattern=None) if f.path == self.path else f for f in contract]

    def inverse(self, leaves: Column) -> Column:
        def back(x: Column) -> Column:
            mine = (x["shape"] == self.path) & (x["kind"] == "integer")
            return x.withField("kind", F.when(mine, "string").otherwise(x["kind"]))

        return F.transform(leaves, back)

    def reversible(self, leaves: Column) -> Column:
        return F.forall(leaves, lambda x: (x["shape"] != self.path) | (x["kind"].isin("integer", "string") & is_canonical_integer(x["text"])))


@dataclass(frozen=True)
class KeyAlias:
    """The external key is called alias inside, in the objects at scope (a shape: keys and * for positions; the root without one)."""

    key: str
    alias: str
    scope: str = ""
    rank = 30

    def forward(self, contract: list[Field]) -> list[Field]:
        old, new = f"{self.scope}/{self.key}", f"{self.scope}/{self.alias}"
        if any(f.path == new for f in contract) or not any(f.path == old for f in contract):
            raise ValueError(f"{old}: alias collides or key is missing")
        return [replace(f, path=new + f.path[len(old) :]) if f.path == old or f.path.startswith(old + "/") else f for f in contract]

    def inverse(self, leaves: Column) -> Column:
        at = self.scope.count("/") + 1
        named = lambda path: F.array_join(F.transform(F.split(path, "/"), lambda part, i: F.when(i == at, self.key).otherwise(part)), "/")
        back = lambda x: x.withField("path", named(x["path"])).withField("shape", named(x["shape"]))
        return F.transform(leaves, lambda x: F.when(_below(x["shape"], self.scope, self.alias), back(x)).otherwise(x))

    def reversible(self, leaves: Column) -> Column:
        return F.forall(leaves, lambda x: ~_below(x["shape"], self.scope, self.key))


@dataclass(frozen=True)
class ScratchField:
    """A bounded string that only the internal objects at scope have."""

    key: str
    max_length: int
    scope: str = ""
    rank = 20

    def forward(self, contract: list[Field]) -> list[Field]:
        path = f"{self.scope}/{self.key}"
        if any(f.path == path for f in contract):
            raise ValueError(f"{path}: key is taken")
        at = next((i for i, f in enumerate(contract) if f.path.startswith(self.scope + "/")), None)
        if at is None:
            raise ValueError(f"{self.scope}: no such scope")
        return [*contract[:at], Field(path, "string", max_length=self.max_length), *contract[at:]]

    def inverse(self, leaves: Column) -> Column:
        return F.filter(leaves, lambda x: x["shape"] != f"{self.scope}/{self.key}")

    def reversible(self, leaves: Column) -> Column:
        mine = F.size(F.filter(leaves, lambda x: x["shape"] == f"{self.scope}/{self.key}"))
        return mine == F.size(F.filter(leaves, lambda x: (x["shape"] == self.scope) & (x["kind"] == "object")))


@dataclass(frozen=True)
class FieldOrder:
    """External keys come in one order, internal ones in another; the whole object is at hand, so it is buffered."""

    external: tuple[str, ...]
    internal: tuple[str, ...]
    rank = 50

    def forward(self, contract: list[Field]) -> list[Field]:
        if sorted(self.external) != sorted(self.internal):
            raise ValueError("orders differ in their keys")
        first = lambda f: self.internal.index(f.path.split("/")[1]) if f.path.split("/")[1] in self.internal else -1
        return sorted(contract, key=first)

    def inverse(self, leaves: Column) -> Column:
        parts = [F.filter(leaves, lambda x: x["path"] == "")]
        parts += [_under(leaves, k) for k in self.external]
        return F.concat(*parts, F.filter(leaves, lambda x: (x["path"] != "") & ~F.split(x["path"], "/")[1].isin(*self.external)))

    def reversible(self, leaves: Column) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, self.external)), key_order(leaves))) == 0


def _under(leaves: Column, key: str) -> Column:
    return F.filter(leaves, lambda x: _within(x["path"], key))


def _below(shape: Column, scope: str, key: str) -> Column:
    """Whether a shape is that of a key of the objects at scope or lies below it."""
    return (shape == f"{scope}/{key}") | shape.startswith(f"{scope}/{key}/")


def _within(path: Column, key: str) -> Column:
    """Whether a path is that of a root key or lies below it."""
    return (path == f"/{key}") | path.startswith(f"/{key}/")


@dataclass(frozen=True)
class Plan:
    """Steps by rank; each path and kind once."""

    external: tuple[Field, ...]
    steps: tuple

    def __post_init__(self):
        ranks = [s.rank for s in self.steps]
        if ranks != sorted(ranks):
            raise ValueError("steps are out of order")
        if len(set(self.steps)) != len(self.steps):
            raise ValueError("a step is repeated")

    def internal(self) -> list[Field]:
        """The contract that the model sees: steps apply from the highest rank down."""
        return reduce(lambda c, s: s.forward(c), reversed(self.steps), list(self.external))

    def digest(self) -> str:
        """A stable hash of the plan and its contract."""
        body = {"external": [asdict(f) for f in self.external], "steps": [[type(s).__name__, asdict(s)] for s in self.steps]}
        return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    def run(self, rows: DataFrame, leaves: Column) -> DataFrame:
        """rows with code and external: code null and the external leaves, or the first failing stage and null.

        Every step is a column of its own, computed once, however often later ones refer to it.
        """
        names = [f"__step_{i}" for i in range(len(self.steps) + 1)]
        out, broken = rows.withColumn(names[0], leaves), F.lit(False)
        for step, before, after in zip(self.steps, names, names[1:], strict=False):
            broken = broken | ~F.coalesce(step.reversible(F.col(before)), F.lit(False))
            out = out.withColumn(after, step.inverse(F.col(before)))
        code = (
            F.when(F.col(names[0]).isNull(), "no_object")
            .when(~conforms(F.col(names[0]), self.internal()), "internal_invalid")
            .when(broken, "not_reversible")
            .when(~conforms(F.col(names[-1]), list(self.external)), "external_invalid")
        )
        return out.withColumn("code", code).withColumn("external", F.when(F.col("code").isNull(), F.col(names[-1]))).drop(*names)


def rendered(leaves: Column, scope: str = "") -> Column:
    """The JSON text of a flat object, keys in their order."""
    inside = F.filter(leaves, lambda x: x["path"].startswith(scope + "/"))
    name = lambda x: F.to_json(F.array(F.substr(x["path"], F.lit(len(scope) + 2))))
    bare = lambda t: F.substr(t, F.lit(2), F.char_length(t) - 2)
    value = lambda x: F.when(x["kind"] == "string", bare(F.to_json(F.array(x["text"])))).when(x["kind"] == "null", "null").otherwise(x["text"])
    return F.concat(F.lit("{"), F.array_join(F.transform(inside, lambda x: F.concat(bare(name(x)), F.lit(":"), value(x))), ","), F.lit("}"))
