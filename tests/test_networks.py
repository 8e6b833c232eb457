"""Networks of either version, by brute force, and files of them."""

import ipaddress
import json
import random
import struct

import pytest

from siltstone.sources import networks, tables

NESTED = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "10.1.2.128/25", "::/0", "2001:db8::/32", "2001:db8:1::/48", "2001:db8:1:2::/64", "2001:db8:1:2::7/128", "fe80::/10", "192.168.0.0/16", "192.168.0.0/17"]


def brute(ip, nets):
    try:
        address = ipaddress.ip_address((ip or "").strip())
    except ValueError:
        return None
    if address.version == 6 and address.ipv4_mapped:
        address = address.ipv4_mapped
    held = [n for n in map(ipaddress.ip_network, nets) if n.version == address.version and address in n]
    if not held and address.version == 4:
        held = [n for n in map(ipaddress.ip_network, nets) if n.version == 6 and ipaddress.ip_address(f"::ffff:{address}") in n]
    return str(max(held, key=lambda n: n.prefixlen)) if held else None


@pytest.mark.parametrize("nets", [NESTED, NESTED[1:6], NESTED[7:], ["1.2.3.4/32"], []])
def test_lookups_equal_brute_force(spark, nets):
    rnd = random.Random(2)
    asked = [f"10.{rnd.randrange(3)}.{rnd.randrange(4)}.{rnd.randrange(256)}" for _ in range(60)] + [f"2001:db8:{rnd.randrange(3):x}:{rnd.randrange(4):x}::{rnd.randrange(9):x}" for _ in range(60)]
    asked += ["1.2.3.4", "::ffff:10.1.2.3", "fe80::1", "255.255.255.255", "::", " 10.1.2.3 ", "10.1.2", "no", "", None, "10.1.2.3", "192.168.200.1", "192.168.100.1"]
    rows = spark.createDataFrame([(k, ip) for k, ip in enumerate(asked)], "id int, ip string")
    known = spark.createDataFrame([(n, n) for n in [*nets, "bad", None]], "network string, name string")
    got = {r["id"]: r["name"] for r in networks.network_lookup(rows, known, "ip").collect()}
    assert got == {k: brute(ip, nets) for k, ip in enumerate(asked)}


def test_equal_networks_give_one_row(spark):
    rows = spark.createDataFrame([("10.0.0.1",)] * 3, "ip string")
    known = spark.createDataFrame([("10.0.0.0/8", "b"), ("10.9.9.9/8", "a"), ("10.0.0.0/8", None)], "network string, name string")
    assert [r["name"] for r in networks.network_lookup(rows, known, "ip").collect()] == ["a"] * 3


def test_a_network_of_all_addresses_is_one_row(spark):
    ranges = spark.createDataFrame([(0, (1 << 32) - 1, "all"), (5, 10, "few"), (9, 3, "none"), (None, 3, "none")], "first long, last long, name string")
    found = networks.networks_of(ranges).collect()
    assert sorted((r["name"], r["network"]) for r in found) == [("all", "0.0.0.0/0"), ("few", "0.0.0.10/32"), ("few", "0.0.0.5/32"), ("few", "0.0.0.6/31"), ("few", "0.0.0.8/31")]
    rows = spark.createDataFrame([("0.0.0.7",), ("9.9.9.9",)], "ip string")
    assert sorted(r["name"] for r in tables.geo_lookup(rows, ranges, "ip").collect()) == ["all", "few"]


def encoded(value):
    """A value as the file format has it."""

    def head(kind, size):
        low, more = (size, b"") if size < 29 else (29, bytes([size - 29])) if size < 285 else (30, struct.pack(">H", size - 285))
        return (bytes([kind << 5 | low]) if kind < 8 else bytes([low, kind - 7])) + more

    if isinstance(value, bool):
        return head(14, int(value))
    if isinstance(value, str):
        return head(2, len(value.encode())) + value.encode()
    if isinstance(value, float):
        return head(3, 8) + struct.pack(">d", value)
    if isinstance(value, dict):
        return head(7, len(value)) + b"".join(encoded(k) + encoded(v) for k, v in value.items())
    if isinstance(value, list):
        return head(11, len(value)) + b"".join(map(encoded, value))
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return head(6 if len(raw) <= 4 else 9 if len(raw) <= 8 else 10, len(raw)) + raw


def file_of(facts, width, version=6):
    """A database: a tree of records, the values, and what describes them."""
    bits = 128 if version == 6 else 32
    nodes, data, places = [[None, None]], b"", {}
    for text, value in facts.items():
        net = ipaddress.ip_network(text)
        number = int(net.network_address)
        depth = net.prefixlen + (96 if net.version == 4 and version == 6 else 0)
        key = json.dumps(value)
        if key not in places:
            places[key] = len(data)
            data += encoded(value)
        at = 0
        for k in range(depth):
            side = number >> (bits - 1 - k) & 1
            if k == depth - 1:
                nodes[at][side] = ("data", places[key])
            else:
                if nodes[at][side] is None:
                    nodes.append([None, None])
                    nodes[at][side] = len(nodes) - 1
                at = nodes[at][side]
    if version == 6:  # 2002::/16 is an alias of the addresses of version 4
        inner = 0
        for _ in range(96):
            inner = nodes[inner][0] if isinstance(inner, int) and inner is not None and isinstance(nodes[inner][0], int) else None
            if inner is None:
                break
        if inner is not None:
            at = 0
            for k in range(16):
                side = 0x2002 >> (15 - k) & 1
                if k == 15:
                    nodes[at][side] = inner
                else:
                    if nodes[at][side] is None:
                        nodes.append([None, None])
                        nodes[at][side] = len(nodes) - 1
                    at = nodes[at][side]
    n, tree = len(nodes), b""
    for pair in nodes:
        a, b = (n if x is None else n + 16 + x[1] if isinstance(x, tuple) else x for x in pair)
        if width == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(width // 8, "big") + b.to_bytes(width // 8, "big")
    meta = {"node_count": n, "record_size": width, "ip_version": version}
    return tree + bytes(16) + data + b"\xab\xcd\xefMaxMind.com" + encoded(meta)


FACTS = {
    "10.1.0.0/16": {"country": {"iso": "CA", "names": {"fr": "Canada é"}}, "lat": 45.25, "eu": False}, "10.2.0.0/15": {"x": 1 << 70}, "192.168.1.128/25": {"long": "y" * 400, "list": [1, True, "a"]}, "1.2.3.4/32": {"n": 7},
    "2001:db8::/32": {"v": 6}, "2001:dead::/48": {"country": {"iso": "US"}}, "fe80::1/128": {"n": 7}, "8000::/1": {"half": True},
}


@pytest.mark.parametrize("width", [24, 28, 32])
def test_network_files(spark, tmp_path, width):
    facts = {k: v for k, v in FACTS.items() if not k.startswith("fe80")}
    path = tmp_path / "nets.db"
    path.write_bytes(file_of(facts, width))
    rows = networks.network_file(spark, str(path))
    assert rows.rdd.getNumPartitions() > 4
    assert sorted((r["network"], r["facts"]) for r in rows.collect()) == sorted((k, json.dumps(v, ensure_ascii=False)) for k, v in facts.items())
    asked = spark.createDataFrame([("10.1.9.9",), ("2001:db8::5",), ("c000::",), ("9.9.9.9",)], "ip string")
    got = {r["ip"]: r["facts"] for r in networks.network_lookup(asked, rows, "ip").collect()}
    assert json.loads(got["10.1.9.9"])["country"]["iso"] == "CA" and json.loads(got["2001:db8::5"]) == {"v": 6} and json.loads(got["c000::"]) == {"half": True} and got["9.9.9.9"] is None


def test_files_of_version_four(spark, tmp_path):
    facts = {k: v for k, v in FACTS.items() if ":" not in k}
    path = tmp_path / "nets.db"
    path.write_bytes(file_of(facts, 24, version=4))
    assert sorted((r["network"], json.loads(r["facts"])) for r in networks.network_file(spark, f"file://{path}").collect()) == sorted(facts.items())


def test_ranges_beyond_all_addresses(spark):
    """A range that leaves version 4's addresses counts as far as they go; one outside holds none."""
    ranges = spark.createDataFrame([(2**32 - 2, 2**32 + 9, "end"), (2**33, 2**33 + 9, "outside"), (-7, 1, "start"), (-9, -8, "before"), (-5, 2**40, "all")], "first long, last long, name string")
    rows = spark.createDataFrame([("255.255.255.255",), ("0.0.0.1",), ("0.0.0.2",)], "ip string")
    found = {r["ip"]: r["name"] for r in tables.geo_lookup(rows, ranges, "ip").collect()}
    assert found == {"255.255.255.255": "end", "0.0.0.1": "start", "0.0.0.2": "all"}
