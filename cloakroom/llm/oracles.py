"""DuckDB SQL for the queries that SQL can express (meant for small tables: it compares plainly)."""

from __future__ import annotations

_WORDS = r"""
    words AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, word
              FROM (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word
                    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)))"""


def _runs(n: int, name: str) -> str:
    """Every ``n`` consecutive words of a document as (doc_id, k, s)."""
    over = f"OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"""
    {name} AS (SELECT doc_id, k, s FROM (SELECT doc_id, k, string_agg(word, ' ') {over} AS s, count(*) {over} AS n FROM words) WHERE n = {n})"""


SUBSTRING_DEDUP = f"""
    WITH {_WORDS}, {_runs(13, "win")},
    hit AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
    gone AS (SELECT w.doc_id, w.k, w.word,
                    max(CASE WHEN h.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS g
             FROM words w LEFT JOIN hit h ON h.doc_id = w.doc_id AND h.k = w.k),
    per AS (SELECT doc_id, count(*) AS n, sum(g) AS r, string_agg(word, ' ' ORDER BY k) FILTER (WHERE g = 0) AS kept FROM gone GROUP BY doc_id)
    SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN per USING (doc_id)"""

SUFFIX_DEDUP = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    win AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
    hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
    island AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g
               FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
    span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM island GROUP BY doc_id, g),
    cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
    per AS (SELECT c.doc_id, count(*) AS spans, sum(b - a) AS removed, max(b) AS last, string_agg(substr(d.h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
            FROM cut c JOIN d USING (doc_id) GROUP BY c.doc_id)
    SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN per USING (doc_id)"""

NGRAM_JOIN = f"""
    WITH RECURSIVE {_WORDS}, {_runs(5, "five")},
    gram AS (SELECT DISTINCT doc_id, s FROM five
             UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY k) FROM words GROUP BY doc_id HAVING count(*) < 5),
    keyed AS (SELECT d.doc_id, md5(coalesce(string_agg(s, chr(10) ORDER BY s), '')) AS key, count(s) AS n
              FROM documents d LEFT JOIN gram USING (doc_id) GROUP BY d.doc_id),
    class AS (SELECT key, min(doc_id) AS class_id, any_value(n) AS n FROM keyed GROUP BY key),
    own AS (SELECT c.class_id, c.n, g.s FROM class c JOIN gram g ON g.doc_id = c.class_id),
    link AS (SELECT a.class_id AS a, b.class_id AS b FROM own a JOIN own b ON a.s = b.s AND a.class_id <> b.class_id
             GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
    reach AS (SELECT class_id AS a, class_id AS b FROM class UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    grp AS (SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY a),
    deg AS (SELECT a AS class_id, count(*) AS n FROM link GROUP BY a)
    SELECT CAST(k.doc_id AS BIGINT) AS doc_id, CAST(c.class_id AS BIGINT) AS class_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, CAST(group_id AS BIGINT) AS group_id
    FROM keyed k JOIN class c USING (key) JOIN grp ON grp.class_id = c.class_id LEFT JOIN deg ON deg.class_id = c.class_id"""


CIRCULANT_MINHASH = rf"""
    WITH RECURSIVE words AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, word
              FROM (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word
                    FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents))),
    {_runs(4, "four")},
    gram AS (SELECT DISTINCT doc_id, s FROM four
             UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY k) FROM words GROUP BY doc_id HAVING count(*) < 4),
    size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
    link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM gram a JOIN gram b ON a.s = b.s AND a.doc_id <> b.doc_id
             JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
             GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(component_id AS BIGINT) AS component_id, doc_id = component_id AS kept
    FROM documents LEFT JOIN size USING (doc_id) JOIN comp USING (doc_id)"""


def _said(columns: list[str]) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)


def _tree(name: str, leaves: str, depth: int) -> str:
    """Levels of a tree over ``leaves`` (g, i from 0, h): name_0, ... A group's last node is carried on unchanged."""
    out = [f"{name}_0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for d in range(depth):
        up = f"SELECT g, i // 3 AS i, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}_{d} GROUP BY g, i // 3"
        out.append(f"{name}_{d + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ({up}))")
    return ",\n    ".join(out)


def _folded(name: str, start: str, carried: str, depth: int) -> str:
    """Fold ``start`` (g, i, h, proof and ``carried``) up the tree with its original siblings: name_up_0, ..."""
    out = [f"{name}_up_0 AS ({start})"]
    for d in range(depth):
        beside = f"(SELECT g, i // 3 AS r, list(h ORDER BY i) AS hs, max(n) AS n FROM {name}_{d} GROUP BY g, i // 3)"
        before, after = "array_to_string(hs[1 : u.i % 3], '')", "array_to_string(hs[u.i % 3 + 2 : 3], '')"
        out.append(f"""{name}_up_{d + 1} AS (SELECT u.g, u.i // 3 AS i, CASE WHEN b.n = 1 THEN h ELSE sha256({before} || h || {after}) END AS h,
            CASE WHEN b.n = 1 THEN proof ELSE proof || {before} || {after} END AS proof, {carried}
            FROM {name}_up_{d} u JOIN {beside} b ON b.g = u.g AND b.r = u.i // 3)""")
    return ",\n    ".join(out)


def _merkle(depth: int = 9) -> str:
    """For up to ``3**depth`` documents a source, and as many sources."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    return f"""
    WITH named AS (SELECT *, dense_rank() OVER (ORDER BY CASE WHEN source IS NULL THEN 0 ELSE 1 END, encode(source)) AS g, {crc} % 2 = 0 AS hit FROM documents),
    hashed AS (SELECT g, doc_id, sha256({_said(columns)}) AS leaf,
                      sha256({_said(columns[:4])} || coalesce(CASE WHEN hit THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') ELSE strlen(text) || ':' || text END, '-')) AS other
               FROM named),
    leaf AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, other, doc_id FROM hashed),
    {_tree("low", "leaf", depth)},
    sub AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS source_g FROM low_{depth}),
    {_tree("top", "sub", depth)},
    {_folded("low", "SELECT g, i, other AS h, '' AS proof, doc_id, h AS leaf FROM leaf", "doc_id, leaf", depth)},
    {_folded("top", f"SELECT 0 AS g, s.i, u.h, u.proof, u.doc_id, u.leaf, s.h AS subroot FROM low_up_{depth} u JOIN sub s ON s.source_g = u.g", "doc_id, leaf, subroot", depth)}
    SELECT CAST(doc_id AS BIGINT) AS doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
    FROM top_up_{depth} u, (SELECT h FROM top_{depth}) r"""


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix_dedup": SUFFIX_DEDUP, "op9_substring_dedup": SUBSTRING_DEDUP, "op10_ngram_join": NGRAM_JOIN, "op11_merkle_manifest": _merkle(), "op13_circulant_minhash": CIRCULANT_MINHASH}
