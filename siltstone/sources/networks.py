"""Facts of networks for addresses of either version, and the file format such facts come in.

An address is a key of 128 bits; one of version 4 lies behind 96 fixed bits. A
network is a key and the number of its leading bits that count. An address finds
its networks by equality, one key for each number of bits that any network has.
"""

from __future__ import annotations

import ipaddress
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.operators.latest import first_by

#: Version 4 addresses follow this prefix, as in addresses of version 6 that hold one.
_MAPPED = 0xFFFF << 32
#: Networks of at most so many own bits are broadcast: there are at most 2 ** 13 for each version.
SHORT_BITS = 12


def _number(text: str) -> int | None:
    """An address as a number of 128 bits; None if it is none."""
    try:
        address = ipaddress.ip_address(text.strip())
    except ValueError:
        return None
    return int(address) if address.version == 6 else _MAPPED | int(address)


def _network(text: str) -> tuple[int, int] | None:
    """A network's number and bits; one that names an address inside it is meant too."""
    try:
        net = ipaddress.ip_network(text.strip(), strict=False)
    except ValueError:
        return None
    return (int(net.network_address), net.prefixlen) if net.version == 6 else (_MAPPED | int(net.network_address), 96 + net.prefixlen)


def network_key(network: Column) -> Column:
    """A network in the usual notation as a struct of ``bits`` and ``key``; null if it is none."""

    @F.arrow_udf("bits int, key binary")
    def run(batch: pa.Array) -> pa.Array:
        found = [None if t is None else _network(t) for t in batch.to_pylist()]
        made = [None if f is None else {"bits": f[1], "key": f[0].to_bytes(16, "big")} for f in found]
        return pa.array(made, pa.struct([("bits", pa.int32()), ("key", pa.binary())]))

    return run(network)


def address_keys(address: Column, bits: list[int]) -> Column:
    """The keys of the networks of so many bits that would hold an address; null if it is none."""
    masks = [(b, ~((1 << (128 - b)) - 1)) for b in sorted(bits)]

    @F.arrow_udf("array<struct<bits:int,key:binary>>")
    def run(batch: pa.Array) -> pa.Array:
        numbers = [None if t is None else _number(t) for t in batch.to_pylist()]
        made = [None if n is None else [{"bits": b, "key": (n & mask).to_bytes(16, "big")} for b, mask in masks] for n in numbers]
        return pa.array(made, pa.list_(pa.struct([("bits", pa.int32()), ("key", pa.binary())])))

    return run(address)


def networks_of(ranges: DataFrame, first: str = "first", last: str = "last", version: int = 4, to: str = "network") -> DataFrame:
    """Ranges of address numbers as networks: a row for each of the few that a range is made of, as column ``to``.

    What lies beyond the version's addresses holds none: a range that leaves them
    counts as far as they go, one outside of them has no row.
    """
    kind, end = (ipaddress.IPv4Address, (1 << 32) - 1) if version == 4 else (ipaddress.IPv6Address, (1 << 128) - 1)

    def parts(first: str | None, last: str | None) -> list[str] | None:
        if first is None or last is None:
            return None
        low, high = max(int(first), 0), min(int(last), end)
        return [str(n) for n in ipaddress.summarize_address_range(kind(low), kind(high))] if low <= high else None

    @F.arrow_udf("array<string>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([parts(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.string()))

    return ranges.withColumn(to, F.explode(run(F.col(first).cast("string"), F.col(last).cast("string"))))


def network_lookup(rows: DataFrame, networks: DataFrame, ip: str, network: str = "network", narrowest: list[Column] | None = None) -> DataFrame:
    """Each row with the facts of the network that holds its address; null where none does.

    Of networks that overlap the one of the most bits counts, or the first by
    ``narrowest``; of equal networks the least by their facts. Addresses and
    networks of either version; what is neither has no facts. Short networks, which
    hold large parts of all addresses, are broadcast, and so no key is hot.
    """
    facts = [c for c in networks.columns if c != network]
    keyed = networks.withColumn("__n", network_key(F.col(network))).where("__n IS NOT NULL").select(F.col("__n.bits").alias("__bits"), F.col("__n.key").alias("__key"), *facts)
    bits = [r[0] for r in keyed.select("__bits").distinct().collect()]  # 129 at most
    order = [*(narrowest or [F.col("__bits").desc()]), *[F.col(c).asc_nulls_last() for c in facts]]
    keyed = first_by(keyed, ["__bits", "__key"], order) if narrowest is None else keyed
    mapped = (F.col("__bits") >= 96) & (F.substring("__key", 1, 12) == F.lit((_MAPPED >> 32).to_bytes(12, "big")))
    own = F.when(mapped, F.col("__bits") - 96).otherwise(F.col("__bits"))
    asked = rows.select(F.col(ip).alias("__ip")).distinct().withColumn("__k", F.explode(address_keys(F.col("__ip"), bits)))
    asked = asked.select("__ip", F.col("__k.bits").alias("__b"), F.col("__k.key").alias("__p"))
    same = (F.col("__b") == F.col("__bits")) & (F.col("__p") == F.col("__key"))
    short = keyed.where(own <= SHORT_BITS)
    near = asked.join(F.broadcast(first_by(short, ["__bits", "__key"], order)), same).unionByName(asked.join(keyed.where(own > SHORT_BITS), same))
    found = first_by(near, ["__ip"], order).select("__ip", *[F.col(c).alias(c) for c in facts])
    return rows.join(found, F.col(ip) == F.col("__ip"), "left").drop("__ip")


# The file format (MaxMind DB). Fixed values, as published.
_METADATA = b"\xab\xcd\xefMaxMind.com"
_GAP = 16
_POINTER, _STRING, _DOUBLE, _BYTES, _UINT16, _UINT32, _MAP, _INT32, _UINT64, _UINT128, _ARRAY, _BOOLEAN, _FLOAT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15
_SIZES = ((29, 1), (285, 2), (65821, 3))
_POINTERS = ((1, 0), (2, 2048), (3, 526336), (4, 0))


class _File:
    """A database in memory: its tree, and the values in its data section."""

    def __init__(self, raw: bytes):
        at = raw.rindex(_METADATA) + len(_METADATA)
        self.raw = raw
        meta, _ = self.value(at, at)
        self.nodes, self.width, self.version = meta["node_count"], meta["record_size"], meta["ip_version"]
        self.tree = self.nodes * self.width // 4
        self.data = self.tree + _GAP
        self.bits = 128 if self.version == 6 else 32
        #: Where addresses of version 4 begin in a tree of version 6; other ways there are aliases of it.
        self.inner = 0
        for _ in range(96 if self.version == 6 else 0):
            if self.inner < self.nodes:
                self.inner = self.child(self.inner, 0)

    def child(self, node: int, side: int) -> int:
        r, at = self.raw, node * self.width // 4
        if self.width == 28:
            high = r[at + 3] >> 4 if side == 0 else r[at + 3] & 0x0F
            return high << 24 | int.from_bytes(r[at + 4 * side : at + 4 * side + 3], "big")
        n = self.width // 8
        return int.from_bytes(r[at + n * side : at + n * side + n], "big")

    def value(self, at: int, base: int) -> tuple[object, int]:
        """The value that begins at an offset, and where it ends; pointers count from ``base``."""
        r = self.raw
        kind, low, at = r[at] >> 5, r[at] & 0x1F, at + 1
        if kind == _POINTER:
            n, more = _POINTERS[low >> 3]
            high = 0 if n == 4 else (low & 7) << (8 * n)
            return self.value(base + (high | int.from_bytes(r[at : at + n], "big")) + more, base)[0], at + n
        if kind == 0:
            kind, at = r[at] + 7, at + 1
        size = low
        if low >= 29:
            least, n = _SIZES[low - 29]
            size, at = least + int.from_bytes(r[at : at + n], "big"), at + n
        if kind == _MAP:
            out: dict = {}
            for _ in range(size):
                key, at = self.value(at, base)
                out[key], at = self.value(at, base)
            return out, at
        if kind == _ARRAY:
            items = []
            for _ in range(size):
                item, at = self.value(at, base)
                items.append(item)
            return items, at
        if kind == _BOOLEAN:
            return bool(size), at
        body, end = r[at : at + size], at + size
        if kind == _STRING:
            return body.decode(), end
        if kind in (_DOUBLE, _FLOAT):
            return struct.unpack(">d" if kind == _DOUBLE else ">f", body)[0], end
        if kind == _BYTES:
            return body.hex(), end
        return int.from_bytes(body, "big", signed=kind == _INT32 and size == 4), end

    def below(self, node: int, number: int, depth: int) -> Iterator[tuple[int, int, int]]:
        """The networks under a node: number, bits, and the offset of their data."""
        todo = [(node, number, depth)]
        while todo:
            node, number, depth = todo.pop()
            if node > self.nodes:
                yield number, depth, node - self.nodes + self.tree
            elif node < self.nodes and not (self.version == 6 and node == self.inner and number >> 32):
                todo += [(self.child(node, side), number | side << (self.bits - 1 - depth), depth + 1) for side in (1, 0)]

    def network(self, number: int, depth: int) -> str:
        if self.version == 4:
            return f"{ipaddress.IPv4Address(number)}/{depth}"
        if depth >= 96 and not number >> 32:
            return f"{ipaddress.IPv4Address(number)}/{depth - 96}"
        return f"{ipaddress.IPv6Address(number)}/{depth}"


def _loaded(path: str) -> _File:
    fs, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    with fs.open_input_file(name) as f:
        return _File(f.read())


class _Subtree(InputPartition):
    def __init__(self, node: int, number: int, depth: int):
        self.node, self.number, self.depth = node, number, depth


class _NetworkReader(DataSourceReader):
    #: Tasks read the subtrees at this depth of the part of the tree that has more than one way.
    DEPTH = 6

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        file = _loaded(self.path)
        level = [(0, 0, 0)]
        if file.version == 6 and file.inner < file.nodes:
            level.append((file.inner, 0, 96))
        for _ in range(self.DEPTH):
            following = []
            for node, number, depth in level:
                ends = node >= file.nodes or (node == file.inner and depth != 96 and file.version == 6)
                following += [(node, number, depth)] if ends else [(file.child(node, s), number | s << (file.bits - 1 - depth), depth + 1) for s in (0, 1)]
            level = following
        return [_Subtree(*x) for x in level]

    def read(self, partition: _Subtree) -> Iterator[tuple[str, str]]:
        file, known = _loaded(self.path), {}
        inside = partition.depth > 96 and not partition.number >> 32
        if partition.node == file.inner and file.version == 6 and not inside:
            return
        for number, depth, at in file.below(partition.node, partition.number, partition.depth):
            if file.version == 6 and not inside and depth > 96 and not number >> 32:
                continue  # the subtrees of version 4 have these
            if at not in known:
                known[at] = json.dumps(file.value(at, file.data)[0], ensure_ascii=False)
            yield file.network(number, depth), known[at]


class NetworkFile(DataSource):
    """``spark.read.format("networks").load(path)``: a database of networks as rows ``network, facts`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "networks"

    def schema(self) -> str:
        return "network string, facts string"

    def reader(self, schema: object) -> _NetworkReader:
        return _NetworkReader(self.options["path"])


def network_file(spark: SparkSession, path: str) -> DataFrame:
    """The networks of a database file with their facts as JSON text; each task walks a part of its tree.

    The file lies where executors can open it too. Aliases of the addresses of
    version 4 that a tree of version 6 has are left out.
    """
    spark.dataSource.register(NetworkFile)
    return spark.read.format("networks").load(path)
