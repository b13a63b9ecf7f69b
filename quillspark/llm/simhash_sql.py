"""Operator 1 as DuckDB SQL, XXH64 included, for comparison with the query.

XXH64 is written out on unsigned 128-bit numbers modulo 2**64. Each step that needs a value twice is a SELECT of its own,
so that the text stays short.
"""

from __future__ import annotations

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED, MOD = 42, 1 << 64


def _u(x: str | int) -> str:
    return f"CAST({x} AS UHUGEINT)" if isinstance(x, str) else f"CAST('{x}' AS UHUGEINT)"


def _rot(x: str, r: int) -> str:
    return f"(({x}) * {_u(1 << r)} % {_u(MOD)} + ({x}) // {_u(1 << (64 - r))})"


def _xor(x: str, y: str) -> str:
    return f"CAST(xor(CAST({x} AS UBIGINT), CAST({y} AS UBIGINT)) AS UHUGEINT)"


def _mul(x: str, k: int) -> str:
    return f"(({x}) * {_u(k)} % {_u(MOD)})"


def _round(v: str, x: str) -> str:
    return _mul(_rot(f"({v} + {_mul(x, P2)}) % {_u(MOD)}", 31), P1)


def _lane(at: str, n: int) -> str:
    """The number in ``n`` bytes from byte ``at`` (from 0) of the hexadecimal text t, least byte first."""
    return "CAST('0x' || " + " || ".join(f"t[2 * ({at} + {i}) + 1 : 2 * ({at} + {i}) + 2]" for i in reversed(range(n))) + " AS UHUGEINT)"


def _avalanche(table: str) -> list[str]:
    steps, at = [], table
    for i, (shift, k) in enumerate(((33, P2), (29, P3), (32, 1))):
        x = _xor("h", f"(h // {_u(1 << shift)})")
        steps.append(f"z{i} AS (SELECT s, {_mul(x, k)} AS h FROM {at})")
        at = f"z{i}"
    return steps


def _hash_steps(table: str) -> list[str]:
    """CTEs from ``table`` (s, distinct texts) to x (s, h)."""
    begins = (SEED + P1 + P2, SEED + P2, SEED, SEED - P1)
    lanes = [f"list_reduce([{_u(b % MOD)}] || [{_lane(f'(32 * q + {8 * i})', 8)} for q in range(0, n // 32)], lambda v, x: {_round('v', 'x')})" for i, b in enumerate(begins)]
    turned = " + ".join(_rot(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18)))
    steps = [
        f"h0 AS (SELECT s, hex(encode(s)) AS t, CAST(octet_length(encode(s)) AS BIGINT) AS n FROM {table})",
        f"h1 AS (SELECT *, {', '.join(f'{x} AS v{i}' for i, x in enumerate(lanes))} FROM h0)",
        f"h2 AS (SELECT *, ({turned}) % {_u(MOD)} AS m0 FROM h1)",
    ]
    for i in range(4):
        mixed = f"({_mul(_xor(f'm{i}', _round(_u(0), f'v{i}')), P1)} + {_u(P4)}) % {_u(MOD)}"
        steps.append(f"h{3 + i} AS (SELECT *, {mixed} AS m{i + 1} FROM h{2 + i})")
    whole = f"(CASE WHEN n >= 32 THEN m4 ELSE {_u(SEED + P5)} END + {_u('n')}) % {_u(MOD)}"
    eight = f"({_mul(_rot(_xor('v', _round(_u(0), 'x')), 27), P1)} + {_u(P4)}) % {_u(MOD)}"
    steps.append(f"h7 AS (SELECT s, t, n, list_reduce([{whole}] || [{_lane('(32 * (n // 32) + 8 * q)', 8)} for q in range(0, (n % 32) // 8)], lambda v, x: {eight}) AS h FROM h6)")
    four = f"({_mul(_rot(_xor('h', _mul(_lane('(8 * (n // 8))', 4), P1)), 23), P2)} + {_u(P3)}) % {_u(MOD)}"
    steps.append(f"h8 AS (SELECT s, t, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM h7)")
    one = _mul(_rot(_xor("v", _mul("x", P5)), 11), P1)
    steps.append(f"h9 AS (SELECT s, list_reduce([h] || [{_lane('(4 * (n // 4) + q)', 1)} for q in range(0, n % 4)], lambda v, x: {one}) AS h FROM h8)")
    return [*steps, *_avalanche("h9"), "x AS MATERIALIZED (SELECT s, CAST(h AS UBIGINT) AS h FROM z2)"]


def simhash_sql(width: int = 4, budget: int = 4) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    bits = ", ".join(f"sum(c * CAST((h >> {b}) & 1 AS BIGINT)) AS b{b}" for b in range(64))
    fp = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {_u(1 << b)} ELSE 0 END" for b in range(64))
    half = "bit_count(CAST(xor({0}, {1}) AS BIGINT))"
    apart = " + ".join(half.format(f"a.{c}", f"b.{c}") for c in ("hi", "lo"))
    ctes = [
        rf"d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents)",
        f"g AS (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + {width - 1}], ' ') for i in range(1, len(w) - {width - 2})] END) AS s FROM d)",
        "c AS MATERIALIZED (SELECT rid, s, count(*) AS c FROM g GROUP BY 1, 2)",
        "u AS MATERIALIZED (SELECT DISTINCT s FROM c)",
        *_hash_steps("u"),
        f"v AS (SELECT rid, sum(c) AS n, {bits} FROM c JOIN x USING (s) GROUP BY 1)",
        f"f AS MATERIALIZED (SELECT d.rid, doc_id, CAST(coalesce({fp}, 0) AS UBIGINT) AS fp FROM d LEFT JOIN v USING (rid))",
        "k AS MATERIALIZED (SELECT fp, fp >> 32 AS hi, fp & 4294967295 AS lo, min(doc_id) AS least, count(*) AS n FROM f GROUP BY fp)",
        f"e AS MATERIALIZED (SELECT a.fp AS p, b.fp AS q FROM k a JOIN k b ON {apart} <= {budget})",
        "r AS (SELECT fp AS p, fp AS q FROM k UNION SELECT r.p, e.q FROM r JOIN e ON r.q = e.p)",
        "m AS (SELECT r.p AS fp, min(least) AS component_id, CAST(sum(n) AS BIGINT) AS n_docs FROM r JOIN k ON k.fp = r.q GROUP BY 1)",
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id, n_docs FROM f JOIN m USING (fp)"
