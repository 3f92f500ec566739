"""DuckDB SQL for the operators that SQL can say."""

from __future__ import annotations

from reelgrid.llm import decontaminate, hyperminhash, spotsigs, windows
from reelgrid.llm import textkernel as tk

_OLD = "".join(map(chr, tk.FOLD))
_NEW = "".join(map(chr, tk.FOLD.values()))


def tokens(text: str) -> str:
    """SQL list of a text's tokens."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_OLD}', '{_NEW}'), '[0-9a-z_\\x{{80}}-\\x{{10ffff}}]+')"


def op5(p: decontaminate.Params = decontaminate.Params()) -> str:
    """Equal windows on a common diagonal, joined to runs; the longest run of each document and item."""
    n = p.min_match
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {tokens("text")} AS t FROM documents),
        b AS (SELECT row_number() OVER () AS bid, item_id, {tokens("text")} AS t FROM benchmark WHERE length(text) > 0),
        n AS (SELECT DISTINCT least({n}, len(t)) AS w FROM b WHERE len(t) > 0),
        dp AS (SELECT rid, doc_id, t, w, unnest(range(1, len(t) - w + 2)) AS p FROM d, n WHERE len(t) >= w),
        dw AS (SELECT rid, doc_id, w, p, array_to_string(list_slice(t, p, p + w - 1), ' ') AS g FROM dp),
        bp AS (SELECT bid, item_id, t, least({n}, len(t)) AS w, unnest(range(1, len(t) - least({n}, len(t)) + 2)) AS q FROM b WHERE len(t) > 0),
        bw AS (SELECT bid, item_id, w, q, array_to_string(list_slice(t, q, q + w - 1), ' ') AS g FROM bp),
        m AS (SELECT rid, doc_id, bid, item_id, w, p, q, p - row_number() OVER (PARTITION BY rid, bid, p - q ORDER BY p) AS isle FROM dw JOIN bw USING (w, g)),
        r AS (SELECT rid, doc_id, bid, item_id, count(*) + any_value(w) - 1 AS n, min(p) - 1 AS dp, min(q) - 1 AS ip FROM m GROUP BY rid, doc_id, bid, item_id, p - q, isle)
    SELECT doc_id, item_id, CAST(n AS INTEGER) AS tokens, CAST(dp AS INTEGER) AS doc_start, CAST(ip AS INTEGER) AS item_start FROM r
    QUALIFY row_number() OVER (PARTITION BY rid, bid ORDER BY n DESC, dp, ip) = 1"""


def op7(p: windows.Params = windows.Params()) -> str:
    """Repeated windows merged to intervals, for op1 as well; 'first' is by doc_id, which is scan order where one file is sorted by it."""
    w = p.width
    return f"""
    WITH d AS (SELECT doc_id, {tokens("text")} AS t FROM documents),
        x AS (SELECT doc_id, t, unnest(range(1, len(t) - {w} + 2)) AS p FROM d WHERE len(t) >= {w}),
        g AS (SELECT doc_id, p, md5(array_to_string(list_slice(t, p, p + {w} - 1), ' ')) AS g FROM x),
        c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM g),
        r AS (SELECT doc_id, p, CASE WHEN k = 1 THEN 'keep' ELSE 'remove' END AS role FROM c WHERE n > 1),
        s AS (SELECT *, CASE WHEN p - lag(p) OVER v <= {w} THEN 0 ELSE 1 END AS new FROM r WINDOW v AS (PARTITION BY doc_id, role ORDER BY p)),
        i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, role ORDER BY p) AS isle FROM s)
    SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS start_token, CAST(max(p) - 1 + {w} AS INTEGER) AS end_token, role FROM i GROUP BY doc_id, role, isle"""


def _groups(threshold: float) -> str:
    """From s (doc_id, g), the distinct features: similar pairs, and the least id that each document reaches."""
    return f"""
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= {threshold}::DOUBLE * (na.n + nb.n - c) - 1e-9),
        sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT a AS id, a AS root FROM sym UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.id),
        grp AS (SELECT id AS doc_id, min(root) AS group_id FROM reach GROUP BY 1)"""


def op6(p: hyperminhash.Params = hyperminhash.Params()) -> str:
    """Exact similarity of all shingle sets; the search by registers reaches the same groups on these tables."""
    k = p.shingle
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, {tokens("text")} AS t FROM documents WHERE doc_id IS NOT NULL),
        x AS (SELECT doc_id, t, unnest(range(1, greatest(len(t) - {k} + 1, 1) + 1)) AS i FROM d WHERE len(t) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(t, i, i + {k} - 1), ' ') AS g FROM x), {_groups(p.threshold)}
    SELECT doc_id, group_id AS duplicate_of FROM grp WHERE doc_id <> group_id"""


def op9(p: spotsigs.Params = spotsigs.Params()) -> str:
    """Exact similarity of all signature sets."""
    quoted = lambda ws: ", ".join(f"'{w}'" for w in ws)
    later = " || ' ' || ".join(f"c[seen + {j}]" for j in range(1, p.chain + 1))
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, {tokens("text")} AS t FROM documents WHERE doc_id IS NOT NULL),
        w AS (SELECT doc_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM d),
        m AS (SELECT *, sum(CASE WHEN w IN ({quoted(p.common)}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS seen FROM w),
        c AS (SELECT doc_id, list(w ORDER BY i) FILTER (w NOT IN ({quoted(p.common)})) AS c FROM w GROUP BY 1),
        a AS (SELECT m.doc_id, m.w, CAST(m.seen AS BIGINT) AS seen, c.c FROM m JOIN c USING (doc_id) WHERE m.w IN ({quoted(p.anchors)})),
        s AS (SELECT DISTINCT doc_id, w || ' ' || {later} AS g FROM a WHERE seen + {p.chain} <= len(c)), {_groups(p.threshold)}
    SELECT doc_id, group_id FROM grp"""
