"""Per-agent metadata schemas: validation of JSON metadata, migration, backfill."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD_TYPES = ("str", "int", "float", "bool", "list", "dict", "any")
OPERATIONS = ("add", "rename", "drop", "change_type")


class SchemaValidationError(ValueError):
    def __init__(self, fields: list[str]):
        super().__init__("; ".join(fields))
        self.fields = fields


class MigrationError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    type: str = "any"
    required: bool = False
    default: object = None
    description: str = ""

    def __post_init__(self):
        if self.type not in FIELD_TYPES:
            raise ValueError(f"unknown field type {self.type}")


@dataclass(frozen=True)
class Schema:
    agent_id: str
    name: str
    fields: dict[str, Field]
    version: int = 1


@dataclass(frozen=True)
class Change:
    op: str
    name: str
    to: str | None = None
    field: Field | None = None


def python_type(value: Column) -> Column:
    """The Python type name of a JSON value given as a variant."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", "str").when(t == "BOOLEAN", "bool").when(t == "BIGINT", "int").when(t.startswith("DECIMAL") | (t == "DOUBLE"), "float").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "dict").otherwise("NoneType")
    )


def field_errors(metadata: Column, fields: dict[str, Field]) -> Column:
    """Error texts of JSON metadata against fields, in the order of the fields. Fields not declared pass."""
    v = F.try_parse_json(F.coalesce(metadata, F.lit("{}")))
    keys = F.json_object_keys(F.coalesce(metadata, F.lit("{}")))
    out = []
    for name, f in fields.items():
        has = F.coalesce(F.array_contains(keys, name), F.lit(False))
        actual = python_type(F.try_variant_get(v, f"$['{name}']", "variant"))
        actual = F.coalesce(actual, F.lit("NoneType"))
        fine = F.lit(True) if f.type == "any" else actual.isin("int", "float") if f.type == "float" else actual == f.type
        missing = F.lit(f"metadata.{name}: required field missing") if f.required and f.default is None else F.lit(None).cast("string")
        wrong = F.concat(F.lit(f"metadata.{name}: expected {f.type}, got "), actual)
        out.append(F.when(~has, missing).when(~fine, wrong))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def errors_of(metadata: Column, fields: Column) -> Column:
    """The same against fields that come as a column; null without fields."""
    values = F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>")

    def error(m, f):
        name, kind = f["name"], f["type"]
        # Fixed texts, as in field_errors
        actual = F.coalesce(python_type(F.element_at(m, name)), F.lit("NoneType"))
        fine = (kind == "any") | (actual == kind) | ((kind == "float") & (actual == "int"))
        missing = F.when(f["must"], F.concat(F.lit("metadata."), name, F.lit(": required field missing")))
        wrong = F.concat(F.lit("metadata."), name, F.lit(": expected "), kind, F.lit(", got "), actual)
        return F.when(~F.coalesce(F.map_contains_key(m, name), F.lit(False)), missing).when(~fine, wrong)

    return F.array_compact(F.flatten(F.transform(F.array(values), lambda m: F.transform(fields, lambda f: error(m, f)))))


class Registry:
    """Schemas by agent, kept as JSON; a file that cannot be read counts as empty."""

    def __init__(self, schemas: list[Schema] | None = None, strict: bool = True):
        self.schemas = {s.agent_id: s for s in schemas or []}
        self.strict = strict

    def register(self, agent_id: str, name: str, fields: dict[str, Field]) -> Schema:
        old = self.schemas.get(agent_id)
        self.schemas[agent_id] = Schema(agent_id, name, dict(fields), old.version + 1 if old else 1)
        return self.schemas[agent_id]

    def get(self, agent_id: str) -> Schema | None:
        return self.schemas.get(agent_id)

    def list(self) -> list[Schema]:
        return [self.schemas[a] for a in sorted(self.schemas)]

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each agent with a schema: agent, fields (name, type, whether one must be there)."""
        rows = [(s.agent_id, [(n, f.type, f.required and f.default is None) for n, f in s.fields.items()]) for s in self.list()]
        return spark.createDataFrame(rows, "_agent string, _fields array<struct<name:string,type:string,must:boolean>>")

    def validate(self, df: DataFrame, metadata: str = "metadata", agent: str = "agent_id") -> DataFrame:
        """df with errors: array of texts; empty for agents without a schema. One expression, however many agents have one."""
        rows = df.join(F.broadcast(self.table(df.sparkSession)), F.col(agent) == F.col("_agent"), "left")
        return rows.withColumn("errors", F.coalesce(errors_of(F.col(metadata), F.col("_fields")), F.array().cast("array<string>"))).select(*df.columns, "errors")

    def validate_and_raise(self, df: DataFrame) -> None:
        if not self.strict:
            return
        bad = self.validate(df).filter(F.size("errors") > 0).select("errors").first()
        if bad:
            raise SchemaValidationError(list(bad["errors"]))

    def to_json(self) -> str:
        return json.dumps([{"agent_id": s.agent_id, "name": s.name, "version": s.version, "fields": {k: vars(f) for k, f in s.fields.items()}} for s in self.list()])

    @classmethod
    def from_json(cls, text: str, strict: bool = True) -> Registry:
        try:
            rows = json.loads(text)
            return cls([Schema(r["agent_id"], r["name"], {k: Field(**f) for k, f in r["fields"].items()}, r["version"]) for r in rows], strict)
        except (ValueError, KeyError, TypeError):
            return cls([], strict)


@dataclass
class Migration:
    """An ordered edit of an agent's schema, from the version it was written for."""

    agent_id: str
    from_version: int
    changes: list[Change] = field(default_factory=list)

    def add(self, name: str, f: Field) -> Migration:
        self.changes.append(Change("add", name, field=f))
        return self

    def rename(self, name: str, to: str) -> Migration:
        self.changes.append(Change("rename", name, to))
        return self

    def drop(self, name: str) -> Migration:
        self.changes.append(Change("drop", name))
        return self

    def change_type(self, name: str, to: str) -> Migration:
        self.changes.append(Change("change_type", name, to))
        return self

    def apply(self, registry: Registry) -> Schema:
        old = registry.get(self.agent_id)
        if old is None:
            raise MigrationError(f"no schema for {self.agent_id}")
        if old.version != self.from_version:
            raise MigrationError(f"schema of {self.agent_id} has version {old.version}, not {self.from_version}")
        fields = dict(old.fields)
        for c in self.changes:
            if c.op == "add":
                if c.name in fields:
                    raise MigrationError(f"{c.name} is there already")
                fields[c.name] = c.field or Field()
                continue
            if c.name not in fields:
                raise MigrationError(f"no field {c.name}")
            if c.op == "drop":
                if fields[c.name].required:
                    raise MigrationError(f"{c.name} is required")
                del fields[c.name]
            elif c.op == "rename":
                if c.to in fields:
                    raise MigrationError(f"{c.to} is there already")
                fields = {c.to if k == c.name else k: f for k, f in fields.items()}
            elif c.op == "change_type":
                fields[c.name] = replace(fields[c.name], type=c.to)
        return registry.register(self.agent_id, old.name, fields)

    def backfill(self, metadata: Column) -> Column:
        """JSON metadata after the changes: added fields get their default where absent, renamed keys move, dropped keys go."""
        m = F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>")
        for c in self.changes:
            has = F.map_contains_key(m, F.lit(c.name))
            if c.op == "add":
                new = F.map_from_arrays(F.array(F.lit(c.name)), F.array(F.parse_json(F.lit(json.dumps(c.field.default if c.field else None)))))
                m = F.when(has, m).otherwise(F.map_concat(m, new))
            elif c.op == "rename":
                m = F.when(has, _renamed(m, c.name, c.to)).otherwise(m)
            elif c.op == "drop":
                m = _dropped(m, c.name)
        return F.to_json(m)

    def plan(self) -> str:
        say = {"add": lambda c: f"add {c.name} ({(c.field or Field()).type})", "rename": lambda c: f"rename {c.name} to {c.to}", "drop": lambda c: f"drop {c.name}", "change_type": lambda c: f"change type of {c.name} to {c.to}"}
        return "\n".join([f"{self.agent_id}: version {self.from_version} to {self.from_version + 1}", *(f"{i}. {say[c.op](c)}" for i, c in enumerate(self.changes, 1))])


def _renamed(m: Column, name: str, to: str) -> Column:
    return F.transform_keys(m, lambda k, _: F.when(k == name, F.lit(to)).otherwise(k))


def _dropped(m: Column, name: str) -> Column:
    return F.map_filter(m, lambda k, _: k != name)
