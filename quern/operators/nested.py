"""Deeply nested records as flat tables: Merkle identities, each object once, bridges for every occurrence.

`shred` turns JSON texts into one long table of nodes; `objects`, `bridge` and `roots` are views of it.

Identity: an object's hash covers its scalar fields by name and the hashes of its parts by field and position, so
equal hashes mean equal subtrees (128-bit BLAKE2b). Field order and 1 against 1.0 make no difference; a null field
and an absent one do. An object whose keys are exactly 0..n-1 is taken for the array it spells out.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.ids import clean_match_id, strip_space
from quern.session import Workspace, spread

NODE_SCHEMA = (
    "kind string, role string, hash binary, fields map<string,string>, "
    "parts array<struct<field:string,ordinal:int,child:binary,value:string>>, record_id bigint, doc_no int, context string"
)
#: Stack of the walk through one document; the walk is plain Python, so that this is no limit of the C stack.
DEEPEST = 1_000_000


def _text(s: str) -> str:
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-8", "replace").decode()


def _scalar(v) -> str:
    """A type letter and the value: s text, n number, b truth value, z null."""
    kind = type(v)
    if kind is int:
        return f"n{v}"
    if kind is str:
        return "s" + (v if v.isascii() else _text(v))
    if kind is bool:
        return "btrue" if v else "bfalse"
    if v is None:
        return "z"
    return f"n{int(v)}" if v.is_integer() and abs(v) < 1e15 else f"n{v!r}"


def _as_list(v):
    """Arrays, also those spelled as an object with the keys 0..n-1; None for anything else."""
    if isinstance(v, list):
        return v
    if isinstance(v, dict) and v and "0" in v:
        n = len(v)
        if all(k.isdecimal() and k.isascii() and int(k) < n and str(int(k)) == k for k in v):
            return [v[str(i)] for i in range(n)]
    return None


def documents_in(value, root_key: str) -> Iterator[dict]:
    """Objects that have an object under root_key, however deep they are wrapped: in arrays, objects or JSON within text.

    RecursionError where text within is nested deeper than the JSON parser goes; other unreadable text holds none.
    """
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            t = x.strip().lstrip("\ufeff").lstrip()
            if t[:1] in ("{", "[", '"'):
                try:
                    stack.append(json.loads(t, parse_float=_number))
                except ValueError:
                    continue
        elif isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            if isinstance(x.get(root_key), dict):
                yield x
            else:
                stack += reversed(x.values())


def _number(s: str) -> int | float:
    """A JSON number with a point or exponent; whole ones as integers, so that 1.0 is 1."""
    x = float(s)
    return int(x) if x.is_integer() and abs(x) < 1e15 else x


def _arrays(v):
    """A value with arrays for those spelled as objects; of any depth the parser reads."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
    items = _as_list(v)
    if items is not None:
        return [_arrays(x) for x in items]
    return {k: _arrays(x) for k, x in v.items()} if isinstance(v, dict) else v


def plain_documents(payload: str | None, root_key: str = "info") -> list[str | None]:
    """JSON of each document in a payload, plainly packed; the payload itself where there is none."""
    if payload is None:
        return [None]
    try:
        text = payload.strip().lstrip("\ufeff").lstrip()
        whole = json.loads(text)
        docs = list(documents_in(whole, root_key))
        if len(docs) == 1 and docs[0] is whole and _arrays(whole) == whole:
            return [text]
        return [json.dumps(_arrays(x)) for x in docs] or [payload]
    except (ValueError, RecursionError):
        return [payload]


def unwrapped(records: DataFrame, payload_column: str, root_key: str = "info", place: str | None = None) -> DataFrame:
    """records with one row for each document in their payload, however wrapped; others keep their row as it is.

    place: name of a column for the document's position within its record, from 0.
    """
    plain = F.udf(lambda x: plain_documents(x, root_key), "array<string>", useArrow=True)
    if place is None:
        return spread(records).withColumn(payload_column, F.explode(plain(F.col(payload_column).cast("string"))))
    rest = [c for c in records.columns if c != payload_column]
    return spread(records).select(*rest, F.posexplode(plain(F.col(payload_column).cast("string"))).alias(place, payload_column))


class _Shredder:
    """Collects nodes of one Arrow batch by column; what was emitted lately is not emitted again."""

    def __init__(self, remember: int = 200_000):
        self.seen: set[bytes] = set()
        self.remember = remember
        self.clear()

    def clear(self) -> None:
        self.kind: list = []
        self.role: list = []
        self.hash: list = []
        self.record: list = []
        self.doc_no: list = []
        self.context: list = []
        self.keys: list = []
        self.values: list = []
        self.field_ends: list = [0]
        self.parts: tuple[list, list, list, list] = ([], [], [], [])
        self.part_ends: list = [0]

    def put(self, obj: dict, role: str) -> bytes:
        keys: list = []
        values: list = []
        parts: list = []
        for name in sorted(obj):
            v = obj[name]
            kind = v.__class__
            if kind is dict or kind is list:
                name = name if name.isascii() else _text(name)
                items = _as_list(v)
                if items is None:
                    parts.append((name, None, self.put(v, f"{role}.{name}"), None))
                    continue
                if items:
                    self.array(parts, name, items, f"{role}.{name}")
                    continue
                v = "[]"
            elif kind is int:
                v = f"n{v}"
            elif kind is str and v.isascii():
                v = f"s{v}"
            else:
                v = _scalar(v)
            keys.append(name if name.isascii() else _text(name))
            values.append(v)
        return self.emit(role, keys, values, parts)

    def array(self, parts: list, key: str, items: list, role: str) -> None:
        for i, x in enumerate(items):
            inner = _as_list(x)
            if inner is not None:
                own: list = []
                self.array(own, "", inner, f"{role}.")
                parts.append((key, i, self.emit(f"{role}.", [], [], own), None))
            elif isinstance(x, dict):
                parts.append((key, i, self.put(x, role), None))
            else:
                parts.append((key, i, None, _scalar(x)))

    def emit(self, role: str, keys: list, values: list, parts: list) -> bytes:
        # Joined by U+0000, with U+0001 between the sections, which is the quicker form, where no text holds those signs;
        # the two forms differ in their first letter, and repr writes neither sign.
        text = "\0".join(keys) + "\1" + "\0".join(values)
        if text.count("\0") == 2 * max(len(keys) - 1, 0) and text.count("\1") == 1:
            text = f"j{text}\1{parts!r}" if parts else "j" + text
        else:
            text = f"r{(keys, values, parts)!r}"
        h = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()
        known = role.encode("utf-8", "replace") + h
        if known not in self.seen:
            if len(self.seen) >= self.remember:
                self.seen.clear()
            self.seen.add(known)
            self.keys += keys
            self.values += values
            for field, ordinal, child, value in parts:
                self.parts[0].append(field)
                self.parts[1].append(ordinal)
                self.parts[2].append(child)
                self.parts[3].append(value)
            self.row("object", role, h)
        return h

    def row(self, kind: str, role: str, h: bytes | None, record=None, doc_no=None, context=None) -> None:
        self.kind.append(kind)
        self.role.append(role)
        self.hash.append(h)
        self.record.append(record)
        self.doc_no.append(doc_no)
        self.context.append(context)
        self.field_ends.append(len(self.keys))
        self.part_ends.append(len(self.parts[0]))

    def batch(self):
        """The rows since the last batch, as Arrow."""
        import pyarrow as pa

        fields = pa.MapArray.from_arrays(pa.array(self.field_ends, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.string())
        inner = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(self.parts, kinds)], names=["field", "ordinal", "child", "value"])
        parts = pa.ListArray.from_arrays(pa.array(self.part_ends, pa.int32()), inner)
        columns = [pa.array(self.kind, pa.string()), pa.array(self.role, pa.string()), pa.array(self.hash, pa.binary()), fields, parts]
        columns += [pa.array(self.record, pa.int64()), pa.array(self.doc_no, pa.int32()), pa.array(self.context, pa.string())]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names=["kind", "role", "hash", "fields", "parts", "record_id", "doc_no", "context"])


def _shred_batches(root_key: str):
    def run(batches):
        sys.setrecursionlimit(DEEPEST)
        s = _Shredder()
        for b in batches:
            for record_id, payload, context in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = payload.as_py()
                if text is None:
                    continue
                try:
                    for n, doc in enumerate(documents_in(text, root_key)):
                        s.row("root", "$", s.put(doc, "$"), record_id, n, context)
                except RecursionError:
                    s.row("unreadable", "", None, record_id, None, context)
                if len(s.kind) >= 4000:
                    yield s.batch()
            yield s.batch()

    return run


def shred(records: DataFrame, id_column: str, payload_column: str, context_column: str, root_key: str = "info") -> DataFrame:
    """Long node table of the match documents in the payloads (NODE_SCHEMA).

    kind 'root': record_id, doc_no (position within the record), context and the document's hash, one for every
    occurrence. kind 'object': role (path of field names from '$', positions left out), hash, scalar fields and parts
    (field, ordinal within its array, child hash or scalar value). Null, empty and unreadable payloads, and values
    without an object under root_key, give no rows. Objects may come more than once from different tasks until
    `objects` removes repeats. kind 'unreadable': a record with text nested deeper than the JSON parser can go; what
    was read of it before holds.
    """
    rows = records.select(F.col(id_column).cast("bigint"), F.col(payload_column).cast("string"), F.col(context_column).cast("string"))
    return spread(rows).mapInArrow(_shred_batches(root_key), NODE_SCHEMA)


def roots(nodes: DataFrame) -> DataFrame:
    """record_id, doc_no, context, hash: one row per document occurrence."""
    return nodes.where("kind = 'root'").select("record_id", "doc_no", "context", "hash")


def objects(nodes: DataFrame, role: str | None = None) -> DataFrame:
    """role, hash, fields, parts: every distinct object of a role once (any role: None)."""
    rows = nodes.where("kind = 'object'") if role is None else nodes.where((F.col("kind") == "object") & (F.col("role") == role))
    return rows.select("role", "hash", "fields", "parts").dropDuplicates(["role", "hash"])


def bridge(nodes: DataFrame, role: str | None = None) -> DataFrame:
    """role, parent, field, ordinal, child, value: the parts of every distinct object; ordinal is null outside arrays."""
    return objects(nodes, role).select("role", F.col("hash").alias("parent"), F.explode("parts").alias("p")).select("role", "parent", "p.field", "p.ordinal", "p.child", "p.value")


def rebuild(root_hash: bytes, by_hash: dict[bytes, tuple[dict, list]]):
    """The document of a hash, from objects given as {hash: (fields, parts)}: inverse of `shred` for small checks."""

    def value(s: str):
        return None if s == "z" else [] if s == "[]" else s[1:] if s[0] == "s" else json.loads(s[1:])

    fields, parts = by_hash[root_hash]
    out: dict = {k: value(v) for k, v in fields.items()}
    for field, ordinal, child, scalar in parts:
        x = value(scalar) if child is None else rebuild(child, by_hash)
        if ordinal is None:
            out[field] = x
        else:
            out.setdefault(field, []).append(x)
    return out.get("") if set(out) == {""} else out


def match_children(nodes: DataFrame) -> DataFrame:
    """match_id, patch, queue_id, child_level, parent_no, child_key of the shredded match documents, distinct rows.

    match_id is metadata.matchId or else the id in the context (a file name), in clean form; patch the first two
    components of gameVersion, '' if absent; queue_id 0 if absent or no number. Levels: participant (player id
    without white space, '' if none), challenge (name with a non-null value), team (id), objective (name of a
    non-null one). Null participants and teams keep their positions but give no rows.
    """

    def scalar(name: str):
        v = F.col("fields")[name]
        return F.when(v.startswith("s") | v.startswith("n"), F.substring(v, 2, 1_000_000_000))

    def child(name: str):
        return F.get(F.filter("parts", lambda p: (p["field"] == name) & p["child"].isNotNull()), F.lit(0))["child"]

    def table(role: str, *cols):
        own = nodes.where((F.col("kind") == "object") & (F.col("role") == role))
        # Equal hashes have equal columns, so whole rows are made distinct: by hashing, without a sort, and parted as
        # the joins need them.
        return own.select(F.col("hash").alias("_h"), *cols).repartition("_h").distinct()

    top = table("$", child("metadata").alias("meta"), child("info").alias("info"))
    meta = table("$.metadata", F.nullif(strip_space(scalar("matchId")), F.lit("")).alias("meta_id"))
    version = F.split(F.coalesce(strip_space(scalar("gameVersion")), F.lit("")), r"\.")
    info = table(
        "$.info",
        F.concat_ws(".", F.slice(version, 1, 2)).alias("patch"),
        F.coalesce(F.try_to_number(scalar("queueId"), F.lit("999999999")).cast("int"), F.lit(0)).alias("queue_id"),
        F.filter("parts", lambda p: p["field"].isin("participants", "teams") & p["ordinal"].isNotNull() & p["child"].isNotNull()).alias("kids"),
    )
    seen = roots(nodes).select(F.col("hash").alias("_h"), "context").distinct()
    docs = seen.join(top, "_h").drop("_h")
    docs = docs.join(meta.withColumnRenamed("_h", "meta"), "meta", "left")
    docs = docs.select(clean_match_id(F.coalesce("meta_id", "context")).alias("match_id"), F.col("info").alias("_h")).distinct()
    kids = docs.join(info, "_h").select("match_id", "patch", "queue_id", F.explode("kids").alias("k"))
    kids = kids.select("match_id", "patch", "queue_id", F.col("k.field").alias("field"), F.col("k.ordinal").alias("parent_no"), F.col("k.child").alias("_h"))

    def named(part: str):
        """Names under an object with a non-null value: scalar fields and parts."""
        return F.array_distinct(F.concat(F.map_keys(F.map_filter("fields", lambda _, v: v != "z")), F.transform("parts", lambda p: p["field"]))).alias(part)

    def level(field: str, role: str, own: str, key, part: str, part_level: str) -> DataFrame:
        members = table(role, key.alias("own_key"), child(part).alias("part"))
        names = table(f"{role}.{part}", named("names")).withColumnRenamed("_h", "part")
        rows = kids.where(F.col("field") == field).join(members, "_h").join(names, "part", "left")
        mine = F.array(F.struct(F.lit(own).alias("child_level"), F.col("own_key").alias("child_key")))
        theirs = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.struct(F.lit(part_level).alias("child_level"), n.alias("child_key")))
        return rows.select("match_id", "patch", "queue_id", "parent_no", F.explode(F.concat(mine, theirs)).alias("c"))

    people = level("participants", "$.info.participants", "participant", F.coalesce(strip_space(scalar("puuid")), F.lit("")), "challenges", "challenge")
    teams = level("teams", "$.info.teams", "team", F.coalesce(strip_space(scalar("teamId")), F.lit("")), "objectives", "objective")
    return people.unionByName(teams).select("match_id", "patch", "queue_id", "c.child_level", "parent_no", "c.child_key").distinct()


def shred_and_keep(records: DataFrame, id_column: str, payload_column: str, context_column: str, root_key: str = "info") -> DataFrame:
    """`shred`, written once to the shared folder: several tables are read from it.

    Rows are sorted by role within each file, so that a table's scan skips the pages of other roles.
    """
    nodes = shred(records, id_column, payload_column, context_column, root_key).sortWithinPartitions("kind", "role")
    return Workspace(records.sparkSession, "nodes").save(nodes, "nodes")
