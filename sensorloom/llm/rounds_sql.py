"""SQL of the operators that work in rounds or levels, one named step a round."""

from __future__ import annotations


def _of(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_of(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: CRC-32 with its usual polynomial, over the digits of the id.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
            lambda c, b: list_reduce(range(8), lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""


def _levels(name: str, first: str, group: str, levels: int) -> list[str]:
    """Steps {name}p1 to {name}pN: the nodes of each level with their children, from rows (group, pos, n, node) of {first}."""
    out, below = [], first
    for k in range(1, levels + 1):
        out.append(f"{name}p{k} AS MATERIALIZED (SELECT {group}, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node, list(node ORDER BY pos) AS kids FROM {below} WHERE n > 1 GROUP BY {group}, pos // 16)")
        below = f"{name}p{k}"
    return out


def _paths(name: str, first: str, group: str, levels: int) -> str:
    """Joins of rows of first (pos, node) to their parents, and arrays of the siblings' texts to the left and right."""
    joins = "".join(f" LEFT JOIN {name}p{k} p{k} ON p{k}.{group} IS NOT DISTINCT FROM r.{group} AND p{k}.pos = r.pos // {16**k}" for k in range(1, levels + 1))
    at = lambda k: f"CAST(r.pos // {16 ** (k - 1)} % 16 AS BIGINT)"
    left = ", ".join(f"array_to_string(p{k}.kids[1 : {at(k)}], '') AS l{k}" for k in range(1, levels + 1))
    right = ", ".join(f"array_to_string(p{k}.kids[{at(k)} + 2 : 16], '') AS r{k}" for k in range(1, levels + 1))
    return f"SELECT r.*, {left}, {right} FROM {first} r{joins}"


def _proof(name: str, levels: int) -> str:
    return " || ".join(f"coalesce({name}.l{k} || {name}.r{k}, '')" for k in range(1, levels + 1))


def _fold(start: str, name: str, levels: int) -> str:
    for k in range(1, levels + 1):
        start = f"if({name}.l{k} IS NULL, {start}, sha256({name}.l{k} || {start} || {name}.r{k}))"
    return start


def merkle(levels: int = 4, tops: int = 2) -> str:
    """The manifest, for sources of up to 16 ** levels documents, 16 ** tops of them."""
    steps = [
        f"""d AS (SELECT doc_id, source, {_leaf('text')} AS node, {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other, {_CRC} % 5 = 0 AS touched FROM documents)""",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d)",
        *_levels("s", "leaves", "source", levels),
        "subs AS MATERIALIZED (SELECT 0 AS one, source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM (" + " UNION ALL ".join(f"SELECT source, node FROM {t} WHERE n = 1" for t in ("leaves", *(f"sp{k}" for k in range(1, levels + 1)))) + "))",
        *_levels("t", "subs", "one", tops),
        "top AS (" + " UNION ALL ".join(f"SELECT node FROM {t} WHERE n = 1" for t in ("subs", *(f"tp{k}" for k in range(1, tops + 1)))) + ")",
        f"a AS MATERIALIZED ({_paths('s', 'leaves', 'source', levels)})",
        f"b AS MATERIALIZED ({_paths('t', 'subs', 'one', tops)})",
        f"""x AS MATERIALIZED (SELECT a.doc_id, a.node AS leaf, b.node AS subroot, top.node AS root, sha256({_proof('a', levels)} || {_proof('b', tops)}) AS proof_sha256,
            {_fold('if(a.touched, a.other, a.node)', 'a', levels)} AS at_source, {', '.join(f'b.l{k}, b.r{k}' for k in range(1, tops + 1))} FROM a JOIN b ON a.source IS NOT DISTINCT FROM b.source JOIN top ON true)""",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, proof_sha256, {_fold('at_source', 'x', tops)} AS folded_root, folded_root = root AS verified FROM x"


def centroids(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c AS MATERIALIZED (SELECT r, i, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, embedding, unnest(range(1, {size + 1})) AS i FROM v))",
        f"k0 AS MATERIALIZED (SELECT cl, i, x FROM c JOIN (SELECT r, row_number() OVER (ORDER BY sha256('{salt}' || coalesce(CAST(vec_id AS VARCHAR), 'null'))) - 1 AS cl FROM v) USING (r) WHERE cl < {k})",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, cl, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, cl) AS place FROM (SELECT c.r, k.cl, CAST(sum((c.x - k.x) * (c.x - k.x)) AS BIGINT) AS d FROM c JOIN k{t} k ON c.i = k.i GROUP BY c.r, k.cl)) WHERE place = 1)")
        if t < rounds:
            steps.append(f"m{t} AS (SELECT cl, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT cl, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN c USING (r) GROUP BY cl, i))")
            steps.append(f"k{t + 1} AS MATERIALIZED (SELECT o.cl, o.i, coalesce(m.x, o.x) AS x FROM k{t} o LEFT JOIN m{t} m ON o.cl = m.cl AND o.i = m.i)")
    steps.append(f"h AS (SELECT cl, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM k{rounds} GROUP BY cl)")
    return f"""WITH {', '.join(steps)} SELECT vec_id, CAST(cl AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cl) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN h USING (cl) JOIN v USING (r)"""
