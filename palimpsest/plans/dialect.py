"""MySQL's SQL as Spark's: tokens, a tree of parentheses, and the expressions whose spelling or meaning differs.

Text is cut into tokens first, so that nothing inside a literal or a quoted name is ever taken for SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from palimpsest.functions import fulltext, mysql

_TOKEN = re.compile(
    r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|/\*.*?\*/|--(?=\s|$)[^\n]*|#[^\n]*|0[xX][0-9A-Fa-f]+|[xX]'[0-9A-Fa-f]*'"
    r"|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|@@?[\w.$]+|[^\W\d][\w$]*|\s+|<=>|->>|->|<<|>>|<>|!=|<=|>=|:=|\|\||&&|.",
    re.S,
)
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}

# MySQL's type names and Spark's.
_TYPES = {
    "tinyint": "tinyint", "bool": "boolean", "boolean": "boolean", "smallint": "smallint", "mediumint": "int", "int": "int", "integer": "int", "bigint": "bigint", "float": "float", "double": "double",
    "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "year": "smallint", "time": "string", "json": "string", "vector": "array<float>", "bit": "bigint", "enum": "string", "set": "string",
    "binary": "binary", "varbinary": "binary", "tinyblob": "binary", "blob": "binary", "mediumblob": "binary", "longblob": "binary",
    "point": "struct<x:double,y:double>", "linestring": "array<struct<x:double,y:double>>", "polygon": "array<array<struct<x:double,y:double>>>",
}
# MySQL's optimizer hints for joins and Spark's.
_HINTS = {"MERGE_JOIN": "MERGE", "HASH_JOIN": "SHUFFLE_HASH", "LOOKUP_JOIN": "BROADCAST", "INNER_JOIN": "SHUFFLE_REPLICATE_NL", "BKA": "BROADCAST", "BNL": "SHUFFLE_HASH"}


def spark_type(text: str) -> str:
    """A MySQL column type as Spark's: unsigned types one size wider, decimals beyond 38 digits as text."""
    m = re.match(r"(\w+)\s*(?:\(([^)]*)\))?(.*)", text.strip(), re.S)
    name, size, rest = m[1].lower(), m[2] or "", m[3].lower()
    if name in ("decimal", "numeric", "dec", "fixed"):
        p, _, s = size.partition(",")
        return "string" if int(p or 10) > 38 else f"decimal({int(p or 10)},{s.strip() or 0})"
    if name == "tinyint" and size.strip() == "1":
        return "boolean"
    kind = _TYPES.get(name, "string")
    if "unsigned" in rest:
        return {"tinyint": "smallint", "smallint": "int", "int": "bigint", "bigint": "decimal(20,0)"}.get(kind, kind)
    return kind


class Group(list):
    """What stands between two parentheses."""


def tokens(text: str) -> list[str]:
    """Tokens without spaces and comments; optimizer hints stay."""
    return [t for t in _TOKEN.findall(text) if not t.isspace() and not t.startswith(("--", "#")) and (not t.startswith("/*") or t.startswith("/*+"))]


def tree(toks: list[str] | str) -> list:
    out: list = []
    stack = [out]
    for t in tokens(toks) if isinstance(toks, str) else toks:
        if t == "(":
            g = Group()
            stack[-1].append(g)
            stack.append(g)
        elif t == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced parentheses")
            stack.pop()
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise ValueError("unbalanced parentheses")
    return out


def text(items: list) -> str:
    """A tree as SQL again; a dotted name without spaces."""
    out = " ".join(f"({text(x)})" if isinstance(x, Group) else x for x in items)
    return re.sub(r"(?<=[\w`]) \. (?=[\w`*])", ".", out) if " . " in out and "'" not in out and '"' not in out else out


def word(x: object) -> str:
    """A token in lower case, without back quotes; "" for a group or a literal."""
    if isinstance(x, Group) or not isinstance(x, str) or x[:1] in "'\"":
        return ""
    return x.lower()


def name(x: str) -> str:
    return x[1:-1].replace("``", "`") if x[:1] == "`" else x


def value(token: str) -> str:
    """What a string literal says."""
    q, body = token[0], token[1:-1]
    body = body.replace(q * 2, q)
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_" else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def literal(v: str) -> str:
    """A text as a string literal of Spark's."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\0", "\\0") + "'"


def json_path(said: str) -> str:
    """A path of MySQL's as Spark's: keys in quotes go into brackets."""
    return re.sub(r'\."([^"]*)"', r"['\1']", said)


def is_string(x: object) -> bool:
    return isinstance(x, str) and x[:1] in ("'", '"')


def unquoted(token: str) -> str:
    return value(token) if is_string(token) else name(token)


def split(items: list, at: str = ",") -> list[list]:
    """The parts between top-level commas (or another token)."""
    out: list[list] = [[]]
    for x in items:
        if x == at:
            out.append([])
        else:
            out[-1].append(x)
    return [] if out == [[]] else out


def find(items: list, *words: str, start: int = 0) -> int:
    """Where the words stand one after the other, outside of parentheses; -1 if nowhere."""
    for i in range(start, len(items) - len(words) + 1):
        if all(word(items[i + k]) == w for k, w in enumerate(words)):
            return i
    return -1


def statements(script: str) -> Iterator[str]:
    """A script's statements; those of a procedure's or trigger's body stay together."""
    now, depth, first = [], 0, []
    for t in _TOKEN.findall(script):
        if t.isspace():
            now.append(" ")
            continue
        if t.startswith(("--", "#")) or (t.startswith("/*") and not t.startswith("/*+")):
            continue
        w = t.lower()
        first.append(w)
        if first[:1] == ["create"] and ({"procedure", "trigger"} & {*first[:6]}):
            depth += (w == "begin") - (w == "end")
        if t == ";" and not depth:
            if "".join(now).strip():
                yield "".join(now).strip()
            now, first = [], []
        else:
            now.append(t)
    if "".join(now).strip():
        yield "".join(now).strip()


# --- functions, by name: arguments as Spark's SQL to Spark's SQL

_DOUBLE = "CAST({} AS DOUBLE)"


def _element(x: str) -> str:
    """A value as JSON text."""
    return f"regexp_replace(to_json(array({x})), '^\\\\[|\\\\]$', '')"


def _strcmp(a: str, b: str) -> str:
    return f"CASE WHEN {a} < {b} THEN -1 WHEN {a} > {b} THEN 1 WHEN {a} = {b} THEN 0 END"


def _truncate(x: str, d: str = "0") -> str:
    return f"(CASE WHEN {x} >= 0 THEN floor({x} * power(10, {d})) ELSE ceil({x} * power(10, {d})) END / power(10, {d}))"


def _vector(x: str) -> str:
    return f"from_json({x}, 'array<float>')" if x[:1] == "'" else x


def _squared(a: str, b: str) -> str:
    return f"aggregate(zip_with({_vector(a)}, {_vector(b)}, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), 0D, (s, v) -> s + v)"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({_vector(a)}, {_vector(b)}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"


def _number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(floor({x}) AS STRING) ELSE CAST({x} AS STRING) END"


def _point_text(p: str) -> str:
    return f"concat({_number(f'({p}).x')}, ' ', {_number(f'({p}).y')})"


def _point_of(t: str) -> str:
    part = lambda i: f"CAST(regexp_extract({t}, 'POINT\\\\s*\\\\(\\\\s*(\\\\S+)\\\\s+(\\\\S+?)\\\\s*\\\\)', {i}) AS DOUBLE)"
    return f"named_struct('x', {part(1)}, 'y', {part(2)})"


def _line_of(t: str) -> str:
    return f"transform(split(trim(regexp_extract({t}, 'LINESTRING\\\\s*\\\\((.*)\\\\)', 1)), '\\\\s*,\\\\s*'), q -> named_struct('x', CAST(split(q, '\\\\s+')[0] AS DOUBLE), 'y', CAST(split(q, '\\\\s+')[1] AS DOUBLE)))"


def _distance(a: str, b: str) -> str:
    return f"sqrt(power(({a}).x - ({b}).x, 2) + power(({a}).y - ({b}).y, 2))"


def _inside(polygon: str, p: str) -> str:
    """Even-odd rule over the edges of the outer ring."""
    edges = f"zip_with({polygon}[0], slice({polygon}[0], 2, size({polygon}[0])), (a, b) -> CASE WHEN b IS NOT NULL AND (a.y > ({p}).y) <> (b.y > ({p}).y) AND ({p}).x < (b.x - a.x) * (({p}).y - a.y) / (b.y - a.y) + a.x THEN 1 ELSE 0 END)"
    return f"(aggregate({edges}, 0, (s, v) -> s + v) % 2 = 1)"


_JSON_OUT = "map('ignoreNullFields', 'false')"


def _pairs(args: tuple[str, ...]) -> tuple[str, str]:
    return f"array({', '.join(args[::2])})", f"array({', '.join(_element(a) for a in args[1::2])})"


def _json_object(*args: str) -> str:
    return f"to_json(named_struct({', '.join(args)}), {_JSON_OUT})" if args else "'{}'"


def _json_change(kind: str):
    def call(document: str, *args: str) -> str:
        paths, values = _pairs(args)
        return f"vc_json_change('{kind}', {document}, {paths}, {values})"

    return call


def _at(document: str, path: str | None) -> str:
    return document if path is None else f"to_json(try_variant_get(try_parse_json({document}), {path}, 'variant'))"


FUNCTIONS: dict[str, Callable[..., str]] = {
    "length": lambda x: f"octet_length({x})", "mid": lambda *a: f"substring({', '.join(a)})", "strcmp": _strcmp,
    "field": lambda x, *v: f"coalesce(array_position(array({', '.join(v)}), {x}), 0)", "elt": lambda n, *v: f"try_element_at(array({', '.join(v)}), CAST({n} AS INT))",
    "insert": lambda s, p, n, new: f"overlay({s} PLACING {new} FROM {p} FOR {n})", "format": lambda x, d: f"format_number({x}, {d})", "oct": lambda x: f"conv({x}, 10, 8)",
    "quote": lambda x: f"concat('\\'', replace(replace({x}, '\\\\', '\\\\\\\\'), '\\'', '\\\\\\''), '\\'')",
    "to_base64": lambda x: f"base64(CAST({x} AS BINARY))", "from_base64": lambda x: f"CAST(unbase64({x}) AS STRING)", "sha": lambda x: f"sha1({x})", "isnull": lambda x: f"isnull({x})",
    "uuid_to_bin": lambda x: f"unhex(replace({x}, '-', ''))", "bin_to_uuid": lambda x: f"lower(regexp_replace(hex({x}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '$1-$2-$3-$4-$5'))",
    "sysdate": lambda *_: "now()", "now": lambda *_: "now()", "current_timestamp": lambda *_: "now()", "localtime": lambda *_: "now()", "utc_timestamp": lambda *_: "to_utc_timestamp(now(), current_timezone())", "utc_date": lambda: "CAST(to_utc_timestamp(now(), current_timezone()) AS DATE)",
    "dayname": lambda x: f"date_format({x}, 'EEEE')", "monthname": lambda x: f"date_format({x}, 'MMMM')", "microsecond": lambda x: f"CAST(unix_micros(CAST({x} AS TIMESTAMP)) % 1000000 AS INT)",
    "to_days": lambda x: f"(datediff({x}, DATE '1970-01-01') + 719528)", "from_days": lambda n: f"date_add(DATE '1970-01-01', CAST({n} AS INT) - 719528)", "makedate": lambda y, n: f"date_add(make_date({y}, 1, 1), {n} - 1)",
    "convert_tz": lambda x, a, b: f"convert_timezone({a}, {b}, CAST({x} AS TIMESTAMP_NTZ))", "timestamp": lambda x: f"CAST({x} AS TIMESTAMP_NTZ)", "weekofyear": lambda x: f"weekofyear({x})",
    "truncate": _truncate, "mod": lambda a, b: f"mod({a}, nullif({b}, 0))", "stddev": lambda x: f"stddev_pop({x})", "std": lambda x: f"stddev_pop({x})", "variance": lambda x: f"var_pop({x})",
    "json_unquote": lambda x: f"CASE WHEN {x} RLIKE '^\".*\"$' THEN try_variant_get(try_parse_json({x}), '$', 'string') ELSE {x} END",
    "json_keys": lambda d, p=None: f"to_json(json_object_keys({_at(d, p)}))", "json_length": lambda d, p=None: f"coalesce(json_array_length({_at(d, p)}), size(json_object_keys({_at(d, p)})), CASE WHEN {_at(d, p)} IS NOT NULL THEN 1 END)",
    "json_valid": lambda x: f"CAST(try_parse_json({x}) IS NOT NULL AS INT)", "json_object": _json_object, "json_array": lambda *a: f"concat('[', concat_ws(',', {', '.join(_element(x) for x in a)}), ']')" if a else "'[]'",
    "json_arrayagg": lambda x: f"to_json(collect_list({x}))", "json_objectagg": lambda k, v: f"to_json(map_from_entries(collect_list(struct({k}, {v}))))", "json_quote": lambda x: _element(x),
    "json_set": _json_change("set"), "json_insert": _json_change("insert"), "json_replace": _json_change("replace"), "json_array_append": _json_change("append"),
    "json_remove": lambda d, *p: f"vc_json_change('remove', {d}, array({', '.join(p)}), array({', '.join(['NULL'] * len(p))}))",
    "json_merge_patch": lambda a, b: f"vc_json_pair('patch', {a}, {b})", "json_merge_preserve": lambda a, b: f"vc_json_pair('preserve', {a}, {b})", "json_merge": lambda a, b: f"vc_json_pair('preserve', {a}, {b})",
    "json_contains": lambda d, c, p=None: f"CAST(vc_json_pair('contains', {_at(d, p)}, {c}) AS INT)", "json_overlaps": lambda a, b: f"CAST(vc_json_pair('overlaps', {a}, {b}) AS INT)",
    "json_contains_path": lambda d, how, *p: f"CAST(({f' {"AND" if "all" in how.lower() else "OR"} '.join(f'try_variant_get(try_parse_json({d}), {x}, \'variant\') IS NOT NULL' for x in p)}) AS INT)",
    "json_type": lambda x: f"CASE WHEN {x} IS NULL THEN NULL ELSE CASE regexp_extract(schema_of_variant(parse_json({x})), '^[A-Za-z]+', 0) WHEN 'OBJECT' THEN 'OBJECT' WHEN 'ARRAY' THEN 'ARRAY' WHEN 'STRING' THEN 'STRING' WHEN 'BIGINT' THEN 'INTEGER' WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'VOID' THEN 'NULL' ELSE 'DOUBLE' END END",
    "regexp_like": lambda x, p, f="''": f"({x} RLIKE concat(CASE WHEN {f} LIKE '%i%' THEN '(?i)' ELSE '' END, {p}))", "rlike": lambda x, p: f"({x} RLIKE {p})",
    "vec_distance": _squared, "vec_distance_l2_squared": _squared, "vec_distance_euclidean": lambda a, b: f"sqrt({_squared(a, b)})", "vec_distance_cosine": lambda a, b: f"(1 - try_divide({_dot(a, b)}, sqrt({_dot(a, a)} * {_dot(b, b)})))",
    "string_to_vector": lambda x: f"from_json({x}, 'array<float>')", "to_vector": lambda x: f"from_json({x}, 'array<float>')", "vector_to_string": lambda x: f"to_json({x})", "from_vector": lambda x: f"to_json({x})", "vector_dim": lambda x: f"size({_vector(x)})",
    "point": lambda x, y: f"named_struct('x', {_DOUBLE.format(x)}, 'y', {_DOUBLE.format(y)})", "linestring": lambda *p: f"array({', '.join(p)})", "polygon": lambda *r: f"array({', '.join(r)})",
    "st_x": lambda p: f"({p}).x", "st_y": lambda p: f"({p}).y", "st_aswkt": lambda p: f"vc_wkt({p})", "st_astext": lambda p: f"vc_wkt({p})", "st_pointfromtext": _point_of, "st_linefromtext": _line_of, "st_linestringfromtext": _line_of,
    "st_geomfromtext": lambda t: _line_of(t) if "linestring" in t.lower() else _point_of(t), "st_distance": _distance, "st_numpoints": lambda x: f"size({x})", "st_startpoint": lambda x: f"{x}[0]", "st_endpoint": lambda x: f"element_at({x}, -1)",
    "st_length": lambda x: f"aggregate(zip_with({x}, slice({x}, 2, size({x})), (a, b) -> CASE WHEN b IS NULL THEN 0D ELSE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) END), 0D, (s, v) -> s + v)",
    "st_contains": _inside, "st_within": lambda p, g: _inside(g, p), "st_equals": lambda a, b: f"({a} <=> {b})", "sleep": lambda _: "0", "connection_id": lambda: "1",
    "benchmark": lambda *_: "0", "name_const": lambda _, v: v,
}

_UNITS = {"microsecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year"}
_BEFORE_TABLE = {"from", "join", "straight_join"}
_ENDS_FROM = {"where", "group", "order", "having", "limit", "union", "intersect", "except", "window", "select", "set", "for", "lock", "into", "values", "qualify"}
_AFTER_TABLE = _ENDS_FROM | {"join", "left", "right", "inner", "full", "cross", "natural", "on", "using", "lateral", "straight_join", "tablesample", "use", "force", "ignore"}
_COMPARE = {"=", "<", ">", "<=", ">=", "<>", "!=", "<=>", "in", "like", "between"}


class Scope:
    """What names mean while a statement is translated. Subclasses know tables, functions and variables."""

    def relation(self, parts: list[str], version: object, alias: bool) -> str | None:
        """A table (its name's parts) as Spark's SQL; None leaves the name as it is. `alias`: whether an alias follows."""
        return None

    def call(self, name_: str, args: list[list]) -> str | None:
        """A function of the scope's own; None if it is none."""
        return None

    def table_function(self, name_: str, args: list[list]) -> str | None:
        return None

    def variable(self, token: str) -> str:
        raise ValueError(f"no variable {token}")

    def recursive(self, name_: str, columns: list[str], base: list, step: list, t: Translator) -> str:
        raise ValueError("a recursion with UNION needs a session")


class Translator:
    def __init__(self, scope: Scope | None = None):
        self.scope = scope or Scope()
        self.ctes: list[set[str]] = []
        self.replaced: dict[str, str] = {}

    def statement(self, sql: str) -> str:
        return self.query(tree(sql))

    # --- queries

    def query(self, items: list) -> str:
        """SELECT, WITH, VALUES, TABLE, with tables and expressions translated."""
        known, kept = set(), dict(self.replaced)
        items = [*items]
        if word(items[0]) == "with" if items else False:
            known = self._with(items)
        elif items and word(items[0]) == "table":
            items[0:1] = ["SELECT", "*", "FROM"]
        self.ctes.append(known)
        try:
            return self._walk(items, relational=True)
        finally:
            self.ctes.pop()
            self.replaced = kept

    def _with(self, items: list) -> set[str]:
        """Names that a WITH clause declares. A recursion that drops repeated rows is run by the scope and leaves the clause."""
        names, i = set(), 2 if word(items[1]) == "recursive" else 1
        recursive, first = i == 2, i
        while True:
            cte, columns = name(items[i]), []
            j = i + 1
            if isinstance(items[j], Group):
                columns, j = [name(c) for c in items[j] if c != ","], j + 1
            if word(items[j]) != "as":
                return names
            body = items[j + 1]
            names.add(cte.lower())
            end = j + 2
            more = end < len(items) and items[end] == ","
            at = find(body, "union")
            if recursive and at >= 0 and word(body[at + 1]) not in ("all",) and self._mentions(body[at + 1 :], cte):
                step = body[at + 1 + (word(body[at + 1]) == "distinct") :]
                self.replaced[cte.lower()] = self.scope.recursive(cte, columns, body[:at], step, self)
                names.discard(cte.lower())
                del items[i : end + more]
                end = i
                if not more:
                    if i == first:
                        del items[0:first]
                    elif items[i - 1] == ",":
                        del items[i - 1]
                    return names
                continue
            if not more:
                return names
            i = end + 1

    def _mentions(self, items: list, cte: str) -> bool:
        return any(self._mentions(x, cte) if isinstance(x, Group) else word(x).strip("`") == cte.lower() for x in items)

    def is_query(self, items: list) -> bool:
        return bool(items) and (word(items[0]) in ("select", "with", "values", "table") or (isinstance(items[0], Group) and self.is_query(items[0]) and (len(items) == 1 or word(items[1]) in ("union", "intersect", "except", "order", "limit"))))

    def expression(self, items: list | str) -> str:
        return self._walk(tree(items) if isinstance(items, str) else items, relational=False)

    def _group(self, g: Group) -> str:
        return f"({self.query(g) if self.is_query(g) else self._walk(g, relational=False)})"

    def _walk(self, items: list, relational: bool) -> str:
        out: list[str] = []
        i, in_from, expect = 0, False, False
        if relational and items and word(items[0]) == "values":
            rows = [f"({', '.join(self.expression(c) for c in split(r[1] if len(r) > 1 else r[0]))})" for r in split(items[1:])]
            return "VALUES " + ", ".join(rows)
        while i < len(items):
            x = items[i]
            w = word(x)
            after = items[i + 1] if i + 1 < len(items) else None
            if relational:
                if w in _BEFORE_TABLE and not (out and out[-1].lower() == "distinct" and w == "from" and len(out) > 1 and out[-2].lower() in ("is", "not")):
                    if w == "from" and word(after) == "dual":
                        i += 2
                        continue
                    in_from, expect = True, True
                    out.append("JOIN" if w == "straight_join" else x)
                    i += 1
                    continue
                if w in _ENDS_FROM:
                    in_from = expect = False
                elif x == "," and in_from:
                    expect = True
                elif expect and w == "lateral":
                    out.append(x)
                    i += 1
                    continue
                elif expect:
                    expect = False
                    taken = self._table(items, i, out)
                    if taken:
                        i = taken
                        continue
                if w == "limit" and i + 3 < len(items) and items[i + 2] == ",":
                    out += ["LIMIT", self._atom(items[i + 3]), "OFFSET", self._atom(items[i + 1])]
                    i += 4
                    continue
                if w == "for" and word(after) in ("update", "share"):
                    i += 2
                    continue
                if w in ("use", "force", "ignore") and word(after) in ("index", "key"):
                    i += 3
                    continue
                if w == "sql_calc_found_rows":
                    i += 1
                    continue
            i = self._item(items, i, out)
        return " ".join(out)

    def _table(self, items: list, i: int, out: list[str]) -> int:
        """Translate the table at i into out; the index after it, or 0 if it is left to the usual way."""
        x = items[i]
        if isinstance(x, Group):
            if self.is_query(x):
                out.append(f"({self.query(x)})")
            else:
                self.ctes.append(set())
                out.append(f"({self._walk(['from', *x], relational=True)[5:]})")
                self.ctes.pop()
            return i + 1
        if is_string(x) or not re.match(r"[\w`]", x):
            return 0
        if i + 1 < len(items) and isinstance(items[i + 1], Group):
            if word(x) == "json_table":
                lateral = "LATERAL " if out and out[-1] in (",", "JOIN", "join") or out[-1].lower() == "join" else ""
                out.append(lateral + self._json_table(items[i + 1]))
                return i + 2
            found = self.scope.table_function(name(x).lower(), split(items[i + 1]))
            if found is None:
                return 0
            out.append(found)
            return i + 2
        parts, j = [name(x)], i + 1
        while j + 1 < len(items) and items[j] == "." and isinstance(items[j + 1], str):
            parts.append(name(items[j + 1]))
            j += 2
        version: object = None
        if j + 1 < len(items) and word(items[j]) == "as" and word(items[j + 1]) == "of":
            k = j + 2
            version = ("time", unquoted(items[k + 1])) if word(items[k]) in ("timestamp", "date") and k + 1 < len(items) and is_string(items[k + 1]) else self._version(items[k])
            j = k + 1 + (word(items[k]) in ("timestamp", "date") and k + 1 < len(items) and is_string(items[k + 1]))
        follows = j < len(items) and not isinstance(items[j], Group) and re.match(r"[\w`]", items[j]) and word(items[j]) not in _AFTER_TABLE
        if len(parts) == 1 and parts[0].lower() in self.replaced:
            out.append(self.replaced[parts[0].lower()] + ("" if follows else f" AS `{parts[0]}`"))
            return j
        if len(parts) == 1 and any(parts[0].lower() in c for c in self.ctes):
            out.append(f"`{parts[0]}`")
            return j
        found = self.scope.relation(parts, version, bool(follows))
        if found is None:
            return 0
        out.append(found)
        return j

    def _version(self, x: object) -> object:
        if isinstance(x, str) and x.startswith("@"):
            x = self.scope.variable(x)
        said = unquoted(x)
        return ("time", said) if re.match(r"\d{4}-\d\d-\d\d", said) else said

    def _json_table(self, g: Group) -> str:
        """JSON_TABLE(document, '$.path[*]' COLUMNS (...)) as an inline of structs."""
        document, rest = split(g)[0], split(g)[1:]
        rest = [x for p in rest for x in [*p, ","]][:-1]
        path, columns = value(rest[0]), split(rest[find(rest, "columns") + 1])
        rows = path.removesuffix("[*]")
        source = self.expression(document)
        found = f"get_json_object({source}, {literal(rows)})" if rows != "$" else source
        listed = f"from_json({found}, 'array<string>')" if path.endswith("[*]") else f"array({found})"
        fields = []
        for c in columns:
            if word(c[1]) == "for":
                fields.append(f"'{name(c[0])}', i + 1")
                continue
            at = find(c, "path")
            kind = spark_type(text(c[1 : at - (word(c[at - 1]) == "exists")]))
            inner = value(c[at + 1])
            get = "e" if inner == "$" else f"get_json_object(e, {literal(inner)})"
            if word(c[at - 1]) == "exists":
                get = f"CAST({get} IS NOT NULL AS INT)"
            default = find(c, "on", "empty")
            if default > 0 and word(c[default - 2]) == "default":
                get = f"coalesce({get}, {self.expression([c[default - 1]])})"
            fields.append(f"'{name(c[0])}', CAST({get} AS {kind})")
        return f"inline(transform({listed}, (e, i) -> named_struct({', '.join(fields)})))"

    # --- expressions

    def _atom(self, x: object) -> str:
        out: list[str] = []
        self._item([x], 0, out)
        return " ".join(out)

    def _primary(self, items: list, i: int) -> tuple[str, int]:
        """The operand that begins at i, and where it ends."""
        out: list[str] = []
        while i < len(items) and items[i] in ("-", "+"):
            out.append(items[i])
            i += 1
        i = self._item(items, i, out)
        return " ".join(out), i

    def _item(self, items: list, i: int, out: list[str]) -> int:
        """Translate what begins at i into out; the index after it."""
        x = items[i]
        if isinstance(x, Group):
            out.append(self._group(x))
            return i + 1
        w = word(x)
        after = items[i + 1] if i + 1 < len(items) else None
        if is_string(x):
            out.append(literal(value(x)))
            return i + 1
        if x.startswith("@"):
            out.append(self.scope.variable(x))
            return i + 1
        if re.match(r"0[xX]", x):
            out.append(f"X'{x[2:]}'")
            return i + 1
        if x.startswith("/*+"):
            kept = [f"{_HINTS[h.upper()]}({a})" for h, a in re.findall(r"(\w+)\s*\(([^)]*)\)", x) if h.upper() in _HINTS] + [h for h in re.findall(r"(?:MERGE|BROADCAST|SHUFFLE_\w+|REPARTITION\w*|REBALANCE|COALESCE)\([^)]*\)", x)]
            if kept:
                out.append(f"/*+ {', '.join(kept)} */")
            return i + 1
        if w == "match" and isinstance(after, Group) and i + 3 < len(items) and word(items[i + 2]) == "against":
            out.append(self._match(after, items[i + 3]))
            return i + 4
        if w == "interval" and after is not None and not isinstance(after, Group) and i + 2 < len(items) and word(items[i + 2]) in _UNITS:
            out.append(f"INTERVAL {self._atom(after)} {items[i + 2]}")
            return i + 3
        if isinstance(after, Group) and re.match(r"[^\W\d]", x) and w not in ("in", "and", "or", "not", "values", "as", "over", "on", "using", "select", "where", "when", "then", "else", "case", "between", "like", "exists", "by", "union", "all", "any", "some", "except", "intersect", "from", "join", "distinct", "div", "rlike", "regexp", "limit", "interval", "within", "is", "having", "with", "lateral", "partition", "sets", "rollup", "cube"):
            return self._call(items, i, w, after, out)
        if w in ("&&", "||"):
            out.append("AND" if w == "&&" else "OR")
            return i + 1
        if w in ("->", "->>") and out:
            out[-1] = self._arrow(out[-1], after, w == "->>" or self._compared(items, i + 2))
            return i + 2
        if w in ("/", "%", "div", "mod") and out:
            operand, end = self._primary(items, i + 1)
            safe = operand if re.fullmatch(r"[1-9]\d*(\.\d+)?", operand) else f"nullif({operand}, 0)"
            out += ["%" if w == "mod" else x, safe]
            return end
        if w == "collate":
            said = name(after).lower()
            out += ["COLLATE", "UTF8_LCASE" if said.endswith("_ci") else "UTF8_BINARY" if said.endswith(("_bin", "_cs")) else name(after)]
            return i + 2
        if w == "binary" and after is not None and after not in (",", ")") and out[-1:] != ["AS"]:
            return i + 1
        if w in ("regexp", "rlike"):
            out.append("RLIKE")
            return i + 1
        if after == "." and i + 2 < len(items) and isinstance(items[i + 2], str) and re.match(r"[\w`@]", x):
            whole, j = x, i + 1
            while j + 1 < len(items) and items[j] == "." and isinstance(items[j + 1], str):
                whole += f".{items[j + 1]}"
                j += 2
            out.append(whole)
            return j
        if w in ("current_timestamp", "localtimestamp") and not isinstance(after, Group):
            out.append("now()")
            return i + 1
        out.append(x)
        return i + 1

    def _compared(self, items: list, i: int) -> bool:
        return i < len(items) and word(items[i]) in _COMPARE

    def _arrow(self, document: str, path: str, plain: bool) -> str:
        return f"get_json_object({document}, {literal(json_path(value(path)))})" if plain else f"to_json(try_variant_get(try_parse_json({document}), {literal(json_path(value(path)))}, 'variant'))"

    def _match(self, columns: Group, against: Group) -> str:
        said = " ".join(value(x) for x in against if is_string(x))
        wanted = [x for x in dict.fromkeys(re.split(fulltext._BREAK.replace("\\p{L}\\p{N}_", "\\w"), said.lower())) if x]
        own = ", ".join(self.expression(c) for c in split(columns))
        listed = ", ".join(literal(x) for x in wanted)
        return f"(size(array_intersect(filter(split(lower(concat_ws(' ', {own})), {literal(fulltext._BREAK)}), w -> w <> ''), array({listed}))) > 0)" if wanted else "false"

    def _call(self, items: list, i: int, w: str, g: Group, out: list[str]) -> int:
        args = split(g)
        own = self.scope.call(w.strip("`"), args)
        if own is not None:
            out.append(own)
            return i + 2
        if w in ("cast", "convert", "try_cast") and find(g, "as") < 0 and find(g, "using") >= 0:
            out.append(f"CAST({self.expression(g[: find(g, 'using')])} AS STRING)")
        elif w in ("cast", "try_cast") and (at := find(g, "as")) >= 0:
            out.append(f"{w.upper()}({self.expression(g[:at])} AS {self.cast_type(g[at + 1 :])})")
        elif w == "convert" and len(args) == 2:
            out.append(f"CAST({self.expression(args[0])} AS {self.cast_type(args[1])})")
        elif w in ("date_add", "date_sub", "adddate", "subdate") and len(args) == 2:
            out.append(self._moved(args, w in ("date_sub", "subdate")))
        elif w in ("timestampadd", "timestampdiff") and len(args) == 3:
            unit = text(args[0]).upper().removeprefix("SQL_TSI_")
            ends = [f"CAST({self.expression(a)} AS TIMESTAMP)" if w == "timestampdiff" or k == 1 else self.expression(a) for k, a in enumerate(args[1:])]
            out.append(f"{w}({unit}, {', '.join(ends)})")
        elif w in ("date_format", "str_to_date") and len(args) == 2 and is_string(args[1][0]):
            pattern = literal(mysql.date_pattern(value(args[1][0])))
            out.append(f"date_format({self.expression(args[0])}, {pattern})" if w == "date_format" else f"try_to_timestamp({self.expression(args[0])}, {pattern})")
        elif w == "group_concat":
            out.append(self._concatenated(g))
        elif w == "json_extract":
            plain = self._compared(items, i + 2) or (out and out[-1].lower() in _COMPARE)
            paths = [[literal(json_path(value(p[0])))] if len(p) == 1 and is_string(p[0]) else p for p in args[1:]]
            found = [f"get_json_object({self.expression(args[0])}, {self.expression(p)})" if plain else f"to_json(try_variant_get(try_parse_json({self.expression(args[0])}), {self.expression(p)}, 'variant'))" for p in paths]
            out.append(found[0] if len(found) == 1 else f"concat('[', concat_ws(',', {', '.join(found)}), ']')")
        elif w in ("extract", "trim", "substring", "substr", "position", "overlay") and (find(g, "from") >= 0 or find(g, "in") >= 0 or find(g, "placing") >= 0):
            out.append(f"{w}({self._walk(g, relational=False)})")
        elif w in FUNCTIONS:
            out.append(FUNCTIONS[w](*[self.expression(a) for a in args]))
        else:
            inner = self.query(g) if self.is_query(g) else self._walk(g, relational=False)
            out.append(f"{items[i]}({inner})")
        return i + 2

    def cast_type(self, items: list) -> str:
        said = text(items).lower()
        if said.startswith(("signed", "unsigned")):
            return "BIGINT"
        if said.startswith(("char", "nchar")):
            return "STRING"
        return said if said.startswith(("array", "struct", "map")) or said in ("string", "variant", "timestamp_ntz", "timestamp", "long") else spark_type(said)

    def _moved(self, args: list[list], back: bool) -> str:
        at, by = args
        when = self.expression(at)
        if len(at) == 1 and is_string(at[0]):
            when = f"{'DATE' if re.fullmatch(r'\d{4}-\d\d-\d\d', value(at[0])) else 'TIMESTAMP'} {when}"
        if word(by[0]) != "interval":
            return f"date_{'sub' if back else 'add'}({when}, CAST({self.expression(by)} AS INT))"
        unit, n = by[-1], by[1:-1]
        if len(n) == 1 and re.fullmatch(r"'?\d+'?", n[0] if isinstance(n[0], str) else ""):
            return f"({when} {'-' if back else '+'} INTERVAL {n[0].strip(chr(39))} {unit})"
        return f"timestampadd({unit.upper()}, {'-' if back else ''}CAST({self.expression(n)} AS INT), {when})"

    def _concatenated(self, g: Group) -> str:
        """GROUP_CONCAT([DISTINCT] x, ... [ORDER BY y] [SEPARATOR s])."""
        distinct = word(g[0]) == "distinct"
        order, sep = find(g, "order", "by"), find(g, "separator")
        end = min(x for x in (order, sep, len(g)) if x >= 0)
        values = split(g[distinct:end])
        joined = f"CAST({self.expression(values[0])} AS STRING)" if len(values) == 1 else f"concat({', '.join(f'CAST({self.expression(v)} AS STRING)' for v in values)})"
        by = self.expression(g[order + 2 : sep if sep > order else len(g)]) if order >= 0 else ""
        if distinct:
            by = joined + (" DESC" if by.upper().endswith(" DESC") else "")
        return f"listagg({'DISTINCT ' if distinct else ''}{joined}, {literal(value(g[sep + 1])) if sep >= 0 else literal(',')}) WITHIN GROUP (ORDER BY {by or joined})"


def mysql_to_spark(sql: str) -> str:
    """An expression or query of MySQL's in Spark's spelling, without any tables of a repo."""
    t = Translator()
    items = tree(sql)
    return t.query(items) if t.is_query(items) else t.expression(items)
