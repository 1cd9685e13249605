"""Schemas as text, how they differ, and how two of them merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = {
    "tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "boolean": "tinyint(1)",
    "string": "longtext", "binary": "longblob", "date": "date", "timestamp": "datetime(6)", "timestamp_ntz": "datetime(6)", "variant": "json",
}

#: Wider types, from narrow to wide, that a value can move along without loss.
_WIDER = [["tinyint", "smallint", "int", "bigint"], ["float", "double"], ["date", "timestamp_ntz"], ["tinyint", "smallint", "int", "double"]]


class SchemaConflict(ValueError):
    """Two schemas that don't merge. kind: NameCollision, TypeChange, DropAndChange, KeyChange, ColumnCheckCollision,
    DeletedCheckCollision, InvalidCheckCollision, DuplicateIndexColumnSet, DefaultCollision or MissingDefault."""

    def __init__(self, message: str, kind: str = "NameCollision"):
        super().__init__(message)
        self.kind = kind


def type_name(kind: T.DataType) -> str:
    name = kind.simpleString()
    return "vector" if name == "array<float>" else "json" if name.startswith(("array", "map", "struct")) else _NAMES.get(name, name)


def column_text(f: T.StructField, keys: Sequence[str], facts: dict) -> str:
    text = f"`{f.name}` {'json' if f.name in facts.get('json', []) else type_name(f.dataType)}"
    if f.name in keys or f.name in facts.get("not_null", []):
        text += " NOT NULL"
    if f.name == facts.get("auto"):
        text += " AUTO_INCREMENT"
    if f.name in facts.get("generated", {}):
        text += f" GENERATED ALWAYS AS ({facts['generated'][f.name]})"
    elif f.name in facts.get("defaults", {}):
        text += f" DEFAULT {facts['defaults'][f.name]}"
    return text


def rule_text(r: dict) -> str:
    quoted = lambda cs: ",".join(f"`{c}`" for c in cs)
    if r["kind"] == "foreign key":
        actions = "".join(f" ON {e.upper()} {r[f'on_{e}'].upper()}" for e in ("delete", "update") if r.get(f"on_{e}", "restrict") != "restrict")
        return f"CONSTRAINT `{r['name']}` FOREIGN KEY ({quoted(r['columns'])}) REFERENCES `{r['parent']}` ({quoted(r['parent_columns'])}){actions}"
    if r["kind"] == "unique index":
        return f"UNIQUE KEY `{r['name']}` ({quoted(r['columns'])})"
    return f"CONSTRAINT `{r['name']}` CHECK ({r['condition']})"


def create_statement(table: str, schema: T.StructType, keys: Sequence[str] = (), facts: dict | None = None) -> str:
    facts = facts or {}
    lines = [f"  {column_text(f, keys, facts)}" for f in schema.fields]
    if keys:
        lines.append(f"  PRIMARY KEY ({','.join(f'`{k}`' for k in keys)})")
    rules = sorted(facts.get("rules", []), key=lambda r: ("unique index", "foreign key", "check constraint").index(r["kind"]))
    lines += [f"  {rule_text(r)}" for r in rules if r["kind"] == "unique index"]
    lines += [f"  {x.get('kind', '').upper() + ' ' if x.get('kind') else ''}KEY `{x['name']}` ({','.join(f'`{c}`' for c in x['columns'])})" for x in facts.get("indexes", [])]
    lines += [f"  {rule_text(r)}" for r in rules if r["kind"] != "unique index"]
    return f"CREATE TABLE `{table}` (\n" + ",\n".join(lines) + "\n);"


def alter_statements(table: str, old: T.StructType, new: T.StructType, keys: Sequence[str] = (), facts: dict | None = None, old_facts: dict | None = None) -> list[str]:
    facts, old_facts = facts or {}, old_facts or {}
    before, after = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    rules, old_rules = ({r["name"]: r for r in x.get("rules", [])} for x in (facts, old_facts))
    out = [f"ALTER TABLE `{table}` DROP CONSTRAINT `{n}`;" for n, r in old_rules.items() if rules.get(n) != r]
    out += [f"ALTER TABLE `{table}` DROP `{c}`;" for c in before if c not in after]
    out += [f"ALTER TABLE `{table}` ADD {column_text(f, [], facts)};" for c, f in after.items() if c not in before]
    out += [f"ALTER TABLE `{table}` MODIFY COLUMN {column_text(f, keys, facts)};" for c, f in after.items() if c in before and column_text(before[c], keys, old_facts) != column_text(f, keys, facts)]
    return out + [f"ALTER TABLE `{table}` ADD {rule_text(r)};" for n, r in rules.items() if old_rules.get(n) != r]


def merge_facts(base: dict, ours: dict, theirs: dict) -> dict:
    """Defaults, not-null columns, rules and indexes of both sides: what one side changed is taken, what both changed differently
    raises SchemaConflict."""
    out: dict = {}
    for kind in ("defaults", "generated"):
        b, o, t = (x.get(kind, {}) for x in (base, ours, theirs))
        held = {}
        for c in dict.fromkeys([*o, *t, *b]):
            x, y, z = b.get(c), o.get(c), t.get(c)
            if y != z and x not in (y, z):
                raise SchemaConflict(f"{c} has two {kind}", "DefaultCollision")
            value = z if y == x else y
            if value is not None:
                held[c] = value
        out[kind] = held
    for kind in ("not_null", "json"):
        b, o, t = ({*x.get(kind, [])} for x in (base, ours, theirs))
        out[kind] = sorted((o & t) | (o - b) | (t - b))
    out["auto"] = ours.get("auto") or theirs.get("auto")
    for kind in ("rules", "indexes"):
        b, o, t = ({r["name"]: r for r in x.get(kind, [])} for x in (base, ours, theirs))
        held = []
        for n in dict.fromkeys([*o, *t]):
            x, y, z = b.get(n), o.get(n), t.get(n)
            if y == z or (x is None and (y is None or z is None)):
                held.append(y or z)
            elif x == y:
                held += [z] if z else []
            elif x == z:
                held += [y] if y else []
            elif y is None or z is None:
                raise SchemaConflict(f"{n} was dropped on one side and changed on the other", "DeletedCheckCollision")
            else:
                raise SchemaConflict(f"both sides have another {n}", "ColumnCheckCollision" if kind == "rules" else "NameCollision")
        sets = [tuple(r["columns"]) for r in held if r.get("columns") and (kind == "indexes" or r["kind"] == "unique index")]
        if len(sets) > len({*sets}):
            raise SchemaConflict("two indexes of the same columns", "DuplicateIndexColumnSet")
        out[kind] = held
    return {k: v for k, v in out.items() if v}


def can_widen(narrow: T.DataType, wide: T.DataType) -> bool:
    a, b = narrow.simpleString(), wide.simpleString()
    if isinstance(narrow, T.DecimalType) and isinstance(wide, T.DecimalType):
        return wide.scale >= narrow.scale and wide.precision - wide.scale >= narrow.precision - narrow.scale
    return a == b or any(a in chain and b in chain and chain.index(a) <= chain.index(b) for chain in _WIDER)


def merge_schemas(*schemas: T.StructType) -> T.StructType:
    """One schema for base, ours and theirs (or for ours and theirs alone).

    A column that one side dropped and the other left alone goes; a column that one side added comes; a type that
    one side widened is taken. The same column added, or changed, to types that don't fit raises SchemaConflict.
    """
    base, ours, theirs = ({f.name: f for f in s.fields} for s in (schemas if len(schemas) == 3 else (T.StructType(), *schemas, *schemas[-1:] * (2 - len(schemas)))))
    out = []
    for c in dict.fromkeys([*ours, *theirs]):
        b, o, t = base.get(c), ours.get(c), theirs.get(c)
        if b and (o is None or t is None):
            left = o or t
            if left.dataType != b.dataType:
                raise SchemaConflict(f"{c} was dropped on one side and changed on the other", "DropAndChange")
            continue
        if o is None or t is None or o.dataType == t.dataType:
            out.append(o or t)
        elif b and o.dataType == b.dataType:
            out.append(t)
        elif b and t.dataType == b.dataType:
            out.append(o)
        elif can_widen(o.dataType, t.dataType):
            out.append(t)
        elif can_widen(t.dataType, o.dataType):
            out.append(o)
        else:
            raise SchemaConflict(f"{c} has types {o.dataType.simpleString()} and {t.dataType.simpleString()}", "TypeChange" if b else "NameCollision")
    return T.StructType(out)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with a schema's columns and types: absent ones null, others cast; what can't be cast becomes null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
