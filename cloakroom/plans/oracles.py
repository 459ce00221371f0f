"""DuckDB SQL oracles for the registered queries (independent re-statements).

DuckDB's RE2 has no lookaround and ASCII ``\\b``/``\\d``; the queries below use
only constructs whose matches agree with the Spark side on the given tables.
"""

from __future__ import annotations

from cloakroom.operators.detect import DEFAULT_PATTERNS

SSN, CARD, AMEX, IP, IBAN, PHONE = (p for p, _ in DEFAULT_PATTERNS)
TEXTS = (("doc", ("documents", "doc_id", "text")), ("page", ("pages", "page_id", "html")))
TOKEN = "[A-Za-z0-9_+/=-]{20,}"
UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LO = "abcdefghijklmnopqrstuvwxyz"


def _positions(src: str, key: str, text: str, pattern: str) -> str:
    """Rows (key, start_pos, value) of every match of ``pattern``."""
    return f"""
    (SELECT {key} AS id,
            CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start_pos,
            ms[i] AS value
     FROM (SELECT {key}, ms, gs, generate_subscripts(ms, 1) AS i
           FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ms,
                        string_split_regex({text}, '{pattern}') AS gs FROM {src})))"""


def _emails(src: str, key: str, text: str) -> str:
    return f"""
    (SELECT {key} AS id, CAST(at_pos - length(loc) AS BIGINT) AS start_pos,
            CAST(at_pos + 1 + length(dom) AS BIGINT) AS end_pos, loc || '@' || dom AS value
     FROM (SELECT {key},
                  regexp_extract(parts[i], '[A-Za-z0-9._%+-]*$') AS loc,
                  rtrim(regexp_extract(parts[i + 1], '^[A-Za-z0-9.-]*'), '.') AS dom,
                  list_sum(list_transform(parts[1:i], lambda x: length(x))) + i - 1 AS at_pos
           FROM (SELECT {key}, parts, generate_subscripts(parts, 1) AS i
                 FROM (SELECT {key}, string_split({text}, '@') AS parts FROM {src}))
           WHERE i < len(parts))
     WHERE length(loc) > 0 AND length(dom) >= 3 AND contains(dom, '.') AND NOT starts_with(dom, '.'))"""


def _entropy_tokens(src: str, key: str, text: str) -> str:
    p = _positions(src, key, text, TOKEN)
    bits = (
        "list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: "
        "-((length(value) - length(replace(value, c, ''))) / length(value)) "
        "* log2((length(value) - length(replace(value, c, ''))) / length(value))))"
    )
    return f"(SELECT id, start_pos, value FROM {p} WHERE {bits} >= 3.5)"


def _kept_ctes(src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs: cand (all floor candidates of the texts, ids as doc_id), conflicts, kept."""
    parts = [
        f"SELECT id, start_pos AS s, end_pos AS e, value AS v, 'EMAIL' AS tag, 'email' AS detector, 3 AS pri, 0.95 AS score, 0 AS ins FROM {_emails(src, key, text)}"
    ]
    for j, (p, tag) in enumerate(zip((SSN, CARD, AMEX, IP, IBAN, PHONE), ("SSN", "CARD", "CARD", "IP", "IBAN", "PHONE"))):
        parts.append(
            f"SELECT id, start_pos, start_pos + length(value), value, '{tag}', 'regex', 3, 0.9, {100000000 + j} FROM {_positions(src, key, text, p)}"
        )
    parts.append(
        f"SELECT id, start_pos, start_pos + length(value), value, 'SECRET', 'entropy', 1, 0.6, 200000000 FROM {_entropy_tokens(src, key, text)}"
    )
    union = "\n UNION ALL ".join(parts)
    above = (
        "(h.pri > c.pri OR (h.pri = c.pri AND (h.blen > c.blen OR (h.blen = c.blen AND "
        "(h.score > c.score OR (h.score = c.score AND (h.s < c.s OR (h.s = c.s AND h.ins < c.ins))))))))"
    )
    levels = ["k1 AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM conf f WHERE f.cid = c.cid))"]
    for lv in range(2, 6):
        levels.append(
            f"k{lv} AS (SELECT * FROM cand c WHERE NOT EXISTS "
            f"(SELECT 1 FROM conf f JOIN k{lv - 1} k ON k.cid = f.hid WHERE f.cid = c.cid))"
        )
    return f"""
    raw AS ({union}),
    cand AS (SELECT row_number() OVER () AS cid, id AS doc_id, s, e, v, tag, detector, pri, score, ins,
                    strlen(v) AS blen FROM raw),
    conf AS (SELECT c.cid, h.cid AS hid FROM cand c JOIN cand h
             ON c.doc_id = h.doc_id AND h.cid <> c.cid AND h.s < c.e AND c.s < h.e AND {above}),
    {", ".join(levels)},
    kept AS (SELECT * FROM k5)"""


def _floor_ctes() -> str:
    """The kept entities of documents, and the vault of their originals."""
    return f"""{_kept_ctes()},
    vault AS (SELECT session, tag, original, n, '__' || tag || '_' || CAST(n AS VARCHAR) || '__' AS placeholder, tag = 'SECRET' AS is_secret
              FROM (SELECT session, tag, original,
                           row_number() OVER (PARTITION BY session, tag ORDER BY first_doc, first_s) AS n
                    FROM (SELECT d.source AS session, k.tag, k.v AS original,
                                 arg_min(k.doc_id, k.doc_id * 1000000000 + k.s) AS first_doc,
                                 arg_min(k.s, k.doc_id * 1000000000 + k.s) AS first_s
                          FROM kept k JOIN documents d ON d.doc_id = k.doc_id
                          GROUP BY d.source, k.tag, k.v)))"""


def _splice(only_secrets: bool = False) -> str:
    return _splice_ctes(only_secrets) + _SPLICE_SELECT


_SPLICE_SELECT = """
    SELECT CAST(d.doc_id AS BIGINT) AS doc_id,
           CASE WHEN a.doc_id IS NULL THEN d.text ELSE a.body || substring(d.text, a.last_e + 1) END AS text
    FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id"""


def _splice_ctes(only_secrets: bool = False) -> str:
    cond = "WHERE vt.is_secret" if only_secrets else ""
    return f"""
    ph AS (SELECT k.doc_id, k.s, k.e, vt.placeholder FROM kept k JOIN documents d ON d.doc_id = k.doc_id
           JOIN vault vt ON vt.session = d.source AND vt.tag = k.tag AND vt.original = k.v {cond}),
    pieces AS (SELECT doc_id, s, e, placeholder, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM ph),
    agg AS (SELECT p.doc_id, string_agg(substring(d.text, p.prev + 1, p.s - p.prev) || p.placeholder, '' ORDER BY p.s) AS body,
                   max(p.e) AS last_e
            FROM pieces p JOIN documents d ON d.doc_id = p.doc_id GROUP BY p.doc_id)"""


def _derived_id_text() -> str:
    return """
    (SELECT c_custkey, concat('ssn ', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '-',
        lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'), '-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'),
        ' iban GB', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'), 'WEST', lpad(CAST(c_custkey AS VARCHAR), 14, '0'),
        ' amex 3', CASE WHEN c_custkey % 2 = 0 THEN '4' ELSE '7' END, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'), ' ',
        lpad(CAST(c_custkey AS VARCHAR), 6, '0'), ' ', lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0'), ' by ', c_name) AS text
     FROM customer)"""


def detection_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["detect_email"] = f"""
        SELECT 'doc' AS src, CAST(id AS BIGINT) AS id, start_pos, end_pos, value AS email FROM {_emails('documents', 'doc_id', 'text')}
        UNION ALL
        SELECT 'page', CAST(id AS BIGINT), start_pos, end_pos, value FROM {_emails('pages', 'page_id', 'html')}"""
    for label, p in (("credit_card", CARD), ("ip_address", IP), ("phone", PHONE)):
        o[f"detect_{label}"] = " UNION ALL ".join(
            f"SELECT '{src}' AS src, CAST(id AS BIGINT) AS id, start_pos, value FROM {_positions(*table, p)}" for src, table in TEXTS
        )
    ids = []
    for label, p in (("ssn", SSN), ("iban", IBAN), ("amex", AMEX)):
        ids.append(
            f"SELECT CAST(id AS BIGINT) AS c_custkey, start_pos, value, '{label}' AS kind FROM {_positions(_derived_id_text(), 'c_custkey', 'text', p)}"
        )
    o["detect_ids"] = "\nUNION ALL\n".join(ids)
    o["detect_entropy"] = " UNION ALL ".join(
        f"SELECT '{src}' AS src, CAST(id AS BIGINT) AS id, start_pos, value AS token FROM {_entropy_tokens(*table)}" for src, table in TEXTS
    )
    o["detect_floor_pages"] = f"""WITH {_kept_ctes('pages', 'page_id', 'html')}
        SELECT CAST(doc_id AS BIGINT) AS page_id, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos, tag, detector, v AS original FROM kept"""
    ctes = _floor_ctes()
    o["detect_floor"] = f"""WITH {ctes}
        SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos,
               tag, detector, v AS original FROM kept"""
    o["intern_session_vault"] = f"WITH {ctes} SELECT session, tag, original, CAST(n AS BIGINT) AS n, placeholder FROM vault"
    o["anonymize_documents"] = f"WITH {ctes}, {_splice()}"
    o["audit_by_kind"] = f"WITH {ctes} SELECT tag, detector, CAST(count(*) AS BIGINT) AS n FROM kept GROUP BY tag, detector"
    o["rehydrate_roundtrip"] = f"WITH {ctes}, {_splice(only_secrets=True)}"
    o["egress_guard_blocked"] = f"""WITH {ctes}
        SELECT d.source AS session, CAST(count(*) AS BIGINT) AS n_leaks FROM kept k JOIN documents d ON d.doc_id = k.doc_id
        WHERE k.detector = 'regex' GROUP BY d.source"""
    o["leak_audit_documents"] = f"WITH {ctes} SELECT CAST(doc_id AS BIGINT) AS doc_id, tag FROM (SELECT DISTINCT doc_id, tag, v FROM kept WHERE doc_id % 11 = 0)"
    keyless = f"""{_kept_ctes()},
        src AS (SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN source END AS session, CASE WHEN doc_id % 5 <> 0 THEN doc_id // 40 END AS ord FROM documents),
        occ AS (SELECT k.doc_id, k.s, k.e, k.v, k.tag, k.detector, x.session, x.ord FROM kept k JOIN src x USING (doc_id)),
        firsts AS (SELECT session, tag, v, min(coalesce(ord, -1) * 1000000000 + s) AS f FROM occ GROUP BY session, tag, v),
        names AS (SELECT session, tag, v, '__' || tag || '_' || CAST(row_number() OVER (PARTITION BY session, tag ORDER BY f, v) AS VARCHAR) || '__' AS placeholder FROM firsts),
        marked AS (SELECT o.doc_id, o.s, o.e, o.tag, n.placeholder FROM occ o JOIN names n ON n.session IS NOT DISTINCT FROM o.session AND n.tag = o.tag AND n.v = o.v),
        bad AS (SELECT DISTINCT session FROM occ WHERE detector <> 'entropy' AND (session IS NULL OR session = 'src1'))"""
    masked = [
        f"""(SELECT p.doc_id, string_agg(substring(d.text, p.prev + 1, p.s - p.prev) || p.placeholder, '' ORDER BY p.s) || substring(any_value(d.text), max(p.e) + 1) AS text
             FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM marked {only}) p JOIN documents d USING (doc_id) GROUP BY p.doc_id)"""
        for only in ("", "WHERE tag = 'SECRET'")
    ]
    o["anonymize_null_keys"] = f"""WITH {keyless}
        SELECT CAST(x.doc_id AS BIGINT) AS doc_id, coalesce(m.text, x.text) AS masked, coalesce(r.text, x.text) AS restored,
               CASE WHEN EXISTS (SELECT 1 FROM bad b WHERE b.session IS NOT DISTINCT FROM x.session) THEN 'blocked' ELSE 'released' END AS verdict
        FROM src x LEFT JOIN {masked[0]} m USING (doc_id) LEFT JOIN {masked[1]} r USING (doc_id)"""
    o["vault_leaks_documents"] = f"""WITH {ctes}, {_splice_ctes()},
        clean AS ({_SPLICE_SELECT}),
        sent AS (SELECT d.doc_id, d.source, c.text || coalesce(' zq' || v.original || 'zq', '') || coalesce(' zq' || cu.c_name || 'zq', '') AS text
                 FROM clean c JOIN documents d USING (doc_id)
                 LEFT JOIN vault v ON v.session = d.source AND v.tag = 'EMAIL' AND v.n = d.doc_id % 3 + 1 AND d.doc_id % 7 = 0
                 LEFT JOIN customer cu ON cu.c_custkey = d.doc_id AND d.doc_id % 13 = 0)
        SELECT CAST(s.doc_id AS BIGINT) AS doc_id, v.tag, v.placeholder FROM sent s JOIN vault v ON v.session = s.source AND contains(s.text, v.original)
        UNION ALL
        SELECT CAST(s.doc_id AS BIGINT), 'PERSON', '__PERSON_' || CAST(c_custkey AS VARCHAR) || '__' FROM sent s JOIN customer ON contains(s.text, c_name)"""
    o["detect_gazetteer"] = f"""
        WITH vocab AS (SELECT DISTINCT lower(w) AS term
                       FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark)
                       WHERE length(w) > 0),
             tok AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents)
        SELECT CAST(doc_id AS BIGINT) AS doc_id, term, CAST(count(*) AS BIGINT) AS hits
        FROM tok JOIN vocab ON translate(w, '{UP}', '{LO}') = translate(term, '{UP}', '{LO}')
        GROUP BY doc_id, term"""
    o["detect_customer_names"] = f"""
        SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS tag, c_name AS original,
               CAST(length(text) - length(c_name) AS BIGINT) AS start_pos
        FROM {_derived_id_text()} JOIN customer USING (c_custkey)"""
    return o


def _memories_sql() -> str:
    return """
    mem AS (SELECT item_id, substr(sha256(CAST(item_id AS VARCHAR) || ':' || text), 1, 16) AS id, text AS content,
                   'fact' AS kind, CASE WHEN item_id % 4 = 0 THEN 'local_only' ELSE 'anonymized' END AS egress_policy,
                   CAST(1700000000000 + item_id * 60000 AS BIGINT) AS created_ms
            FROM benchmark),
    q AS (SELECT conv_id AS qid, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def _bm25_sql(cap: int | None = None) -> str:
    first = "" if cap is None else f"WHERE r <= {cap}"
    return f"""
    mw AS (SELECT id, unnest(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM mem),
    mt AS (SELECT id, strip_accents(lower(w)) AS term FROM mw WHERE length(w) > 0),
    dl AS (SELECT m.id, count(mt.term) AS dl FROM mem m LEFT JOIN mt ON mt.id = m.id GROUP BY m.id),
    stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    post AS (SELECT id, term, count(*) AS tf FROM mt GROUP BY id, term),
    dfq AS (SELECT term, count(*) AS nhit FROM post GROUP BY term),
    qw AS (SELECT qid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
           FROM (SELECT qid, regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+') AS ws FROM q)),
    qa AS (SELECT qid, translate(w, '{UP}', '{LO}') AS aw, min(i) AS fi FROM qw WHERE strlen(w) >= 3 GROUP BY qid, aw),
    qt AS (SELECT qid, strip_accents(lower(aw)) AS term
           FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fi) AS r FROM qa) {first}),
    sc AS (SELECT qt.qid, post.id,
                  round(sum(CASE WHEN ln((stats.n - dfq.nhit + 0.5) / (dfq.nhit + 0.5)) <= 0 THEN 1e-6
                                 ELSE ln((stats.n - dfq.nhit + 0.5) / (dfq.nhit + 0.5)) END
                            * post.tf * 2.2 / (post.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / stats.avgdl))), 9) AS score
           FROM qt JOIN post ON post.term = qt.term JOIN dfq ON dfq.term = qt.term JOIN dl ON dl.id = post.id, stats
           GROUP BY qt.qid, post.id),
    kw AS (SELECT qid, id, rk FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM sc) WHERE rk <= 8)"""


def _hash_sql(src: str, key: str, text: str, name: str) -> str:
    """CTE ``name``(key, b, x): non-zero cells of the normalised hash embedding."""
    return f"""
    {name}_t AS (SELECT {key} AS k, md5(translate(w, '{UP}', '{LO}')) AS h
                 FROM (SELECT {key}, unnest(regexp_split_to_array({text}, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {src})
                 WHERE strlen(w) >= 2),
    {name}_r AS (SELECT k, CAST(('0x' || substr(h, 1, 8))::BIGINT % 64 AS BIGINT) AS b,
                        sum(CASE WHEN ('0x' || substr(h, 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x
                 FROM {name}_t GROUP BY k, b),
    {name} AS (SELECT r.k, r.b, r.x / sqrt(s.ss) AS x FROM {name}_r r
               JOIN (SELECT k, sum(x * x) AS ss FROM {name}_r GROUP BY k) s ON s.k = r.k
               WHERE r.x <> 0)"""


def _semantic_hash_sql() -> str:
    return f"""
    {_hash_sql('q', 'qid', 'text', 'qv')},
    {_hash_sql('mem', 'id', 'content', 'mv')},
    ss AS (SELECT qv.k AS qid, mv.k AS id, round(sum(qv.x * mv.x), 9) AS score FROM qv JOIN mv ON qv.b = mv.b GROUP BY qv.k, mv.k),
    sem AS (SELECT qid, id, rk FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk
                                     FROM ss WHERE score > 0) WHERE rk <= 8)"""


def _fused_sql() -> str:
    return f"""WITH {_memories_sql()}, {_bm25_sql()}, {_semantic_hash_sql()},
    fused AS (SELECT qid, id, CAST(rk AS BIGINT) AS rank FROM kw
              UNION ALL
              SELECT s.qid, s.id, CAST(s.rk + 8 AS BIGINT) FROM sem s
              WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.qid = s.qid AND kw.id = s.id)),
    sel AS (SELECT * FROM (SELECT f.qid, f.id, f.rank, m.content,
                                  sum(CAST(floor(strlen(m.content) / 4) + 2 AS BIGINT)) OVER (PARTITION BY f.qid ORDER BY f.rank
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
                           FROM fused f JOIN mem m ON m.id = f.id WHERE m.egress_policy = 'anonymized')
            WHERE used <= 400)"""


def memory_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["chat_gather_text"] = "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
    for name, cap in (("memory_recall_bm25", 32), ("memory_recall_all_words", None)):
        o[name] = f"WITH {_memories_sql()}, {_bm25_sql(cap)} SELECT qid AS conv_id, id, CAST(rk AS BIGINT) AS rk FROM kw"
    o["memory_semantic_orders"] = f"""WITH
        q AS (SELECT o_orderkey AS qid, o_orderpriority || ' k' || CAST(o_orderkey % 97 AS VARCHAR) AS text FROM orders),
        mem AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' low medium high urgent k' || CAST(p_partkey % 97 AS VARCHAR) AS content FROM part),
        {_semantic_hash_sql()} SELECT qid AS o_orderkey, id AS p_partkey, CAST(rk AS BIGINT) AS rk FROM sem"""
    o["memory_semantic_topk"] = """
        WITH u AS (SELECT label, i, avg(embedding[i]) AS a
                   FROM (SELECT label, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
             c AS (SELECT label, list(a ORDER BY i) AS cen FROM u GROUP BY label),
             s AS (SELECT c.label, e.vec_id, round(list_cosine_similarity(c.cen, CAST(e.embedding AS DOUBLE[])), 9) AS score
                   FROM c, embeddings e)
        SELECT label, vec_id, CAST(rk AS BIGINT) AS rk
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rk FROM s WHERE score > 0)
        WHERE rk <= 8"""
    o["hash_embed_memories"] = f"WITH {_memories_sql()}, {_hash_sql('mem', 'id', 'content', 'mv')} SELECT k AS id, b, round(x, 6) AS x FROM mv"
    o["memory_semantic_hash"] = f"WITH {_memories_sql()}, {_semantic_hash_sql()} SELECT qid AS conv_id, id, CAST(rk AS BIGINT) AS rk FROM sem"
    o["memory_fuse_budget"] = f"{_fused_sql()} SELECT qid AS conv_id, id, rank, used FROM sel"
    o["memory_block"] = (
        f"{_fused_sql()} SELECT qid AS conv_id, 'Relevant context about the user (use only if helpful):' || chr(10) "
        "|| string_agg('- ' || content, chr(10) ORDER BY rank) AS block FROM sel GROUP BY qid"
    )
    promote = f"""WITH {_memories_sql()},
        ev AS (SELECT m.id, CAST(epoch_us(e.ts) // 1000 AS BIGINT) AS ts_ms, e.event_id FROM events e JOIN mem m ON e.user_id % (SELECT count(*) FROM mem) = m.item_id),
        agg AS (SELECT id, count(*) AS n, max(ts_ms) AS last FROM ev GROUP BY id),
        third AS (SELECT id, ts_ms FROM (SELECT id, ts_ms, row_number() OVER (PARTITION BY id ORDER BY ts_ms, event_id) AS r FROM ev) WHERE r = 3),
        pm AS (SELECT m.id, m.content, m.kind, m.egress_policy, m.created_ms, CAST(coalesce(a.n, 0) AS BIGINT) AS recall_count,
                      coalesce(a.last, m.created_ms) AS accessed_ms, coalesce(a.n, 0) >= 3 AS promoted, t.ts_ms AS promoted_at_ms
               FROM mem m LEFT JOIN agg a ON a.id = m.id LEFT JOIN third t ON t.id = m.id)"""
    o["memory_promote"] = f"{promote} SELECT id, recall_count, accessed_ms, promoted, promoted_at_ms FROM pm"
    o["memory_export"] = f"""{promote}
        SELECT CAST(line_no AS BIGINT) AS line_no, line FROM (
          SELECT 1 AS line_no, '# Memory' AS line UNION ALL SELECT 2, '' UNION ALL
          SELECT 3, 'One line per stored memory: text, kind, egress policy and how often it was recalled; * marks promoted ones.' UNION ALL SELECT 4, ''
          UNION ALL
          SELECT 4 + row_number() OVER (ORDER BY promoted DESC, recall_count DESC, created_ms DESC, id),
                 '- ' || CASE WHEN promoted THEN '* ' ELSE '' END || content || '  _(' || kind || ', ' || egress_policy
                 || ', recalled ' || CAST(recall_count AS VARCHAR) || 'x)_'
          FROM pm)"""
    o["memory_list"] = f"WITH {_memories_sql()} SELECT CAST(row_number() OVER (ORDER BY created_ms DESC, id) AS BIGINT) AS list_rank, id, content, kind, egress_policy, created_ms FROM mem"
    o["memory_local_terms"] = f"WITH {_memories_sql()} SELECT content FROM mem WHERE egress_policy = 'local_only'"
    o["memory_delete"] = f"""WITH {_memories_sql()}
        SELECT id, created_ms FROM mem WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
    return o


def _vocab_hits_sql() -> str:
    return f"""
    vocab AS (SELECT DISTINCT lower(w) AS term
              FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark)
              WHERE length(w) > 0),
    tok AS (SELECT doc_id, source, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
            FROM (SELECT doc_id, source, regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+') AS ws FROM documents)),
    hits AS (SELECT t.* FROM tok t JOIN vocab v ON translate(t.w, '{UP}', '{LO}') = translate(v.term, '{UP}', '{LO}'))"""


def vault_oracles() -> dict[str, str]:
    key = "correct horse battery staple"
    o: dict[str, str] = {}
    o["vault_lookup_keys"] = f"""
        SELECT c_custkey, sha256(unhex(sha256('cloakroom lookup 1:' || '{key}')) || encode('PERSON') || unhex('1f') || encode(c_name)) AS lookup
        FROM customer"""
    o["vault_seal_roundtrip"] = "SELECT c_custkey, true AS restored, true AS wrong_key_null, CAST(12 + strlen(c_name) + 16 AS BIGINT) AS sealed_len FROM customer"
    durable = f"""WITH {_vocab_hits_sql()},
        ranked AS (SELECT w AS original, run, source, doc_id, i, row_number() OVER (PARTITION BY w ORDER BY run, source, doc_id, i) AS r
                   FROM (SELECT *, CASE WHEN doc_id < 500 THEN 1 ELSE 2 END AS run FROM hits)),
        numbered AS (SELECT original, row_number() OVER (ORDER BY run, source, doc_id, i) AS n FROM ranked WHERE r = 1)
        SELECT 'PRIVATE' AS tag, original, CAST(n AS BIGINT) AS n, '__PRIVATE_' || CAST(n AS VARCHAR) || '__' AS placeholder FROM numbered"""
    o["durable_vault_increment"] = durable
    o["durable_vault_keyed"] = durable
    o["anonymize_degraded"] = f"""
        SELECT c_custkey, substr(text, 1, length(text) - length(c_name)) || '__PROJECT_h'
               || substr(sha256(encode('PROJECT') || unhex('1f') || encode(c_name)), 1, 16) || '__' AS text
        FROM {_derived_id_text()} JOIN customer USING (c_custkey)"""
    # an address is longer than its words, which are masked with it
    o["layered_rehydrate"] = f"""WITH {_vocab_hits_sql()},
        durable AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id),
        mail AS (SELECT id, unnest(regexp_split_to_array(value, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {_emails('documents', 'doc_id', 'text')}),
        inside AS (SELECT id, count(v.term) AS n FROM mail LEFT JOIN vocab v ON translate(mail.w, '{UP}', '{LO}') = translate(v.term, '{UP}', '{LO}') GROUP BY id)
        SELECT CAST(d.doc_id AS BIGINT) AS doc_id, text, CAST(coalesce(durable.n, 0) - coalesce(inside.n, 0) AS BIGINT) AS durable, inside.id IS NOT NULL AS mail
        FROM documents d LEFT JOIN durable USING (doc_id) LEFT JOIN inside ON inside.id = d.doc_id"""
    return o


def chat_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    call = """CASE o_orderkey % 4 WHEN 0 THEN '{"note":"a}b","order":' || CAST(o_orderkey AS VARCHAR) || '}'
                    ELSE '{"order":' || CAST(o_orderkey AS VARCHAR) || '}' END"""
    o["rescue_tool_calls"] = f"""
        SELECT o_orderkey, 'lookup_order' AS name, {call} AS arguments FROM orders WHERE o_orderkey % 4 <> 3"""
    o["eval_requests"] = """
        SELECT CAST(doc_id AS BIGINT) AS doc_id, '{"model":"auto","messages":[{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '}]}' AS request,
               CASE WHEN doc_id % 5 = 0 THEN text ELSE '' END AS content FROM documents"""
    o["guard_chat_requests"] = """
        SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CASE WHEN conv_id % 7 IN (1, 2, 3, 4) THEN 'blocked' ELSE 'released' END AS verdict FROM conversations"""
    o["deep_tool_descriptions"] = """
        WITH b AS (SELECT s_suppkey, '{"tools":[{"a.b[0]":' || repeat('{"p":[', 40) || '{"description":"ask '
                          || CASE WHEN s_suppkey % 10 = 9 THEN 's' || CAST(s_suppkey AS VARCHAR) || '@supply.example.org' ELSE '__EMAIL_1__' END
                          || '"}' || repeat(']}', 40) || '}]}' AS body FROM supplier)
        SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN substr(body, 1, length(body) - 3) ELSE body END AS body FROM b"""
    o["rescue_multi_choice"] = f"""
        WITH t AS (SELECT *, o_orderkey % 2 = 0 AS tools, 'o' || CAST(o_orderkey AS VARCHAR) || '@shop.example' AS mail, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
        c0 AS (SELECT o_orderkey, 0 AS choice, tools AND o_orderkey % 4 <> 3 AS hit, {call} AS args, 'lookup_order' AS name,
                      CASE o_orderkey % 4 WHEN 0 THEN '[TOOL_CALLS]lookup_order{{"order": ' || k || ', "note": "a}}b"}}'
                           WHEN 1 THEN '<tool_call>{{"name": "lookup_order", "arguments": {{"order": ' || k || '}}}}</tool_call>'
                           WHEN 2 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{{"name":"lookup_order","parameters":{{"order":' || k || '}}}}' || chr(10) || '```'
                           ELSE 'Order ' || k || ' ships soon [1].' END AS content FROM t),
        c1 AS (SELECT o_orderkey, 1, tools AND o_orderkey % 3 = 1, '{{"a":null,"to":"' || mail || '","z":1}}', 'mail',
                      CASE o_orderkey % 3 WHEN 0 THEN '{{"name":null,"arguments":{{"order":1}}}}'
                           WHEN 1 THEN '{{"name":"mail","arguments":{{"z":1,"to":"' || mail || '","a":null}}}}' ELSE 'plain ' || mail END FROM t)
        SELECT o_orderkey, CAST(choice AS BIGINT) AS choice, CASE WHEN NOT hit THEN content END AS content, CASE WHEN hit THEN name END AS name,
               CASE WHEN hit THEN args END AS arguments, CASE WHEN hit THEN 'tool_calls' END AS finish_reason, CAST(3 AS BIGINT) AS usage,
               'r' || CAST(o_orderkey AS VARCHAR) AS reply_id
        FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1)"""
    o["llm_reply_terms"] = """
        SELECT c_custkey, trim(c_name) AS term,
               CASE WHEN c_custkey % 3 = 0 THEN 'person' WHEN c_custkey % 3 = 1 THEN 'org' ELSE 'private' END AS kind
        FROM customer WHERE c_custkey % 5 <> 4"""
    first, last = "regexp_extract(text, '[A-Za-z]{4,}')", "regexp_extract(text, '([A-Za-z]{4,})[^A-Za-z]*$', 1)"

    def passed(reply: str) -> str:
        there = f"contains(lower({reply}), lower({last}))"
        return f"(doc_id % 7 <> 0 AND CASE WHEN doc_id % 3 = 1 AND {last} <> '' THEN NOT {there} ELSE contains(lower({reply}), lower({first})) AND {there} END)"

    o["eval_outcomes"] = f"""WITH {_floor_ctes()}, {_splice_ctes(only_secrets=True)}, restored AS ({_SPLICE_SELECT}),
        sens AS (SELECT DISTINCT doc_id FROM kept),
        answers AS (SELECT d.doc_id, d.text, CASE WHEN d.doc_id % 5 = 0 THEN string_split(d.text, chr(10))[1] ELSE d.text END AS plain,
                           CASE WHEN d.doc_id % 5 = 0 THEN string_split(CASE WHEN d.doc_id % 11 = 0 THEN d.text ELSE r.text END, chr(10))[1]
                                WHEN d.doc_id % 11 = 0 THEN d.text ELSE r.text END AS back
                    FROM documents d JOIN restored r ON r.doc_id = d.doc_id)
        SELECT CAST(doc_id AS BIGINT) AS doc_id, {passed("plain")} AS baseline_pass, {passed("back")} AS anon_pass,
               doc_id % 11 = 0 AND doc_id IN (SELECT doc_id FROM sens) AS leaked,
               CASE WHEN doc_id % 7 = 0 THEN 'timeout' END AS error
        FROM answers"""
    o["eval_report"] = f"""WITH outc AS ({o['eval_outcomes']}),
        rates AS (SELECT count(*) AS n, coalesce(avg(baseline_pass::INT::DOUBLE) FILTER (WHERE error IS NULL), 0) AS b,
                         coalesce(avg(anon_pass::INT::DOUBLE) FILTER (WHERE error IS NULL), 0) AS a, count(*) FILTER (WHERE leaked) AS l FROM outc)
        SELECT CAST(n AS BIGINT) AS scenarios, round(b, 6) AS baseline_rate, round(a, 6) AS anon_rate,
               round(CASE WHEN b = 0 THEN 1.0 ELSE least(a / b, 1.0) END, 6) AS retention, CAST(l AS BIGINT) AS leaks
        FROM rates"""
    o["eval_report_lines"] = f"""WITH outc2 AS ({o['eval_outcomes']}), rep AS ({o['eval_report']})
        SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS line_no,
               'scenario=document ' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || ' baseline=' || CASE WHEN baseline_pass THEN 'pass' ELSE 'fail' END
               || ' anonymized=' || CASE WHEN anon_pass THEN 'pass' ELSE 'fail' END || ' leak=' || CASE WHEN leaked THEN 'yes' ELSE 'no' END
               || coalesce(' error=' || error, '') AS line
        FROM outc2
        UNION ALL
        SELECT scenarios + 1, 'total scenarios=' || CAST(scenarios AS VARCHAR) || ' baseline=' || printf('%.4f', baseline_rate) || ' anonymized='
               || printf('%.4f', anon_rate) || ' retention=' || printf('%.4f', retention) || ' leaks=' || CAST(leaks AS VARCHAR) FROM rep"""
    o["route_candidates"] = """
        WITH models AS (SELECT lower(replace(p_brand, '#', '-')) || '/class-' || CAST(class AS VARCHAR) AS model_id,
                               min(p_retailprice) AS priority, min(p_partkey) AS ins, class % 2 = 1 AS tools
                        FROM (SELECT *, CAST(floor(p_size / 10) AS INTEGER) AS class FROM part) GROUP BY p_brand, class),
             req AS (SELECT conv_id, bool_or(role = 'system') AS needs_tools FROM conversations GROUP BY conv_id)
        SELECT conv_id, model_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY priority, ins) AS BIGINT) AS pref
        FROM req JOIN models ON (NOT needs_tools) OR tools"""
    return o


def dialect_oracles() -> dict[str, str]:
    return {
        "normalize_transcripts": """
        WITH sys AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id),
        rows AS (
          SELECT conv_id, -1 AS turn, 0 AS sub, 'system' AS role, text AS content, NULL AS tool_call_id, NULL AS call_turn
          FROM sys WHERE text <> ''
          UNION ALL
          SELECT conv_id, turn, 0, 'assistant', CASE WHEN text = '' THEN NULL ELSE text END, NULL,
                 CASE WHEN turn % 4 = 1 THEN CAST(turn AS VARCHAR) END
          FROM conversations WHERE role = 'assistant'
          UNION ALL
          SELECT conv_id, turn, 0, 'user', text, NULL, NULL FROM conversations WHERE role = 'user' AND turn % 4 <> 2
          UNION ALL
          SELECT conv_id, turn, 0, 'tool', 'ok', 'toolu_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR), NULL
          FROM conversations WHERE role = 'user' AND turn % 4 = 2
          UNION ALL
          SELECT conv_id, turn, 1, 'user', text, NULL, NULL FROM conversations WHERE role = 'user' AND turn % 4 = 2 AND text <> '')
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) - 1 AS BIGINT) AS ord,
               role, content, tool_call_id, call_turn
        FROM rows"""
    }


def chat_field_oracles() -> dict[str, str]:
    return {
        "chat_fields_anonymize": """
        WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS mi FROM conversations),
        f AS (
          SELECT conv_id, 'messages[' || CAST(mi AS VARCHAR) || '].content' AS path,
                 CASE WHEN turn = 0 THEN text || ' mail __EMAIL_1__' ELSE text END AS text FROM c
          UNION ALL
          SELECT conv_id, 'messages[' || CAST(mi AS VARCHAR) || '].tool_calls[0].function.arguments',
                 '{"to":"__EMAIL_1__","n":' || CAST(turn AS VARCHAR) || '}' FROM c WHERE role = 'assistant' AND turn % 4 = 1
          UNION ALL
          SELECT DISTINCT conv_id, 'tools[0].function.description', 'Send mail via __EMAIL_2__' FROM c
          UNION ALL
          SELECT DISTINCT conv_id, 'tools[0].function.parameters.properties.to.description', 'recipient, e.g. __EMAIL_1__' FROM c)
        SELECT CAST(conv_id AS VARCHAR) AS session, path, text FROM f"""
    }


def joined_gazetteer_oracles() -> dict[str, str]:
    runs = "regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')"
    return {
        "detect_gazetteer_joined": f"""
        WITH br AS (SELECT {runs} AS r FROM benchmark),
        bi AS (SELECT r, generate_subscripts(r, 1) AS i FROM br),
        vocab AS (
          SELECT DISTINCT lower(r[i]) AS term FROM bi WHERE regexp_matches(r[i], '^[\\p{{L}}\\p{{N}}]')
          UNION
          SELECT DISTINCT lower(r[i] || ' ' || r[i + 2]) FROM bi
          WHERE i + 2 <= len(r) AND r[i + 1] = ' ' AND regexp_matches(r[i], '^[\\p{{L}}\\p{{N}}]') AND lower(r[i]) <> lower(r[i + 2])),
        dr AS (SELECT doc_id, {runs} AS r FROM documents),
        di AS (SELECT doc_id, r, generate_subscripts(r, 1) AS i FROM dr),
        hits AS (
          SELECT doc_id, translate(r[i], '{UP}', '{LO}') AS k FROM di
          UNION ALL
          SELECT doc_id, translate(r[i] || ' ' || r[i + 2], '{UP}', '{LO}') FROM di WHERE i + 2 <= len(r) AND r[i + 1] = ' ')
        SELECT CAST(h.doc_id AS BIGINT) AS doc_id, v.term, CAST(count(*) AS BIGINT) AS hits
        FROM hits h JOIN vocab v ON h.k = translate(v.term, '{UP}', '{LO}')
        GROUP BY h.doc_id, v.term"""
    }


def discovered_oracles() -> dict[str, str]:
    runs = "regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')"
    return {
        "anonymize_with_discovered": f"""
        WITH w2 AS (SELECT DISTINCT conv_id, translate(w, '{UP}', '{LO}') AS term, CASE WHEN conv_id % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS tag
                    FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS w FROM conversations)),
        runs AS (SELECT conv_id, turn, r, generate_subscripts(r, 1) AS i
                 FROM (SELECT conv_id, turn, {runs} AS r FROM conversations)),
        hit AS (SELECT u.conv_id, u.turn, u.i, u.r[u.i] AS orig, w2.tag FROM runs u JOIN w2 ON w2.conv_id = u.conv_id
                AND translate(u.r[u.i], '{UP}', '{LO}') = w2.term),
        firsts AS (SELECT conv_id, tag, orig, min(turn * 1000000 + i) AS f FROM hit GROUP BY conv_id, tag, orig),
        num AS (SELECT *, row_number() OVER (PARTITION BY conv_id, tag ORDER BY f) AS n FROM firsts),
        out AS (SELECT u.conv_id, u.turn,
                       string_agg(CASE WHEN h.orig IS NULL THEN u.r[u.i] ELSE '__' || h.tag || '_' || CAST(n.n AS VARCHAR) || '__' END, '' ORDER BY u.i) AS text
                FROM runs u
                LEFT JOIN hit h ON h.conv_id = u.conv_id AND h.turn = u.turn AND h.i = u.i
                LEFT JOIN num n ON n.conv_id = h.conv_id AND n.tag = h.tag AND n.orig = h.orig
                GROUP BY u.conv_id, u.turn)
        SELECT CAST(c.conv_id AS BIGINT) AS conv_id, CAST(c.turn AS BIGINT) AS turn, coalesce(o.text, c.text) AS text
        FROM conversations c LEFT JOIN out o ON o.conv_id = c.conv_id AND o.turn = c.turn"""
    }


def outbound_oracles() -> dict[str, str]:
    runs = "regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')"
    return {
        "prepare_outbound_conversations": f"""{_fused_sql()},
        blk AS (SELECT qid AS conv_id, -1 AS turn,
                       'Relevant context about the user (use only if helpful):' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY rank) AS text
                FROM sel GROUP BY qid),
        msgs AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn, text FROM blk),
        vocab AS (SELECT DISTINCT lower(w) AS term
                  FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark) WHERE length(w) > 0),
        runs AS (SELECT conv_id, turn, r, generate_subscripts(r, 1) AS i FROM (SELECT conv_id, turn, {runs} AS r FROM msgs)),
        hit AS (SELECT u.conv_id, u.turn, u.i, u.r[u.i] AS orig FROM runs u JOIN vocab v
                ON translate(u.r[u.i], '{UP}', '{LO}') = translate(v.term, '{UP}', '{LO}')),
        firsts AS (SELECT conv_id, orig, min((turn + 1) * 1000000 + i) AS f FROM hit GROUP BY conv_id, orig),
        num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY f) AS n FROM firsts),
        out AS (SELECT u.conv_id, u.turn,
                       string_agg(CASE WHEN h.orig IS NULL THEN u.r[u.i] ELSE '__PRIVATE_' || CAST(n.n AS VARCHAR) || '__' END, '' ORDER BY u.i) AS text
                FROM runs u LEFT JOIN hit h ON h.conv_id = u.conv_id AND h.turn = u.turn AND h.i = u.i
                LEFT JOIN num n ON n.conv_id = h.conv_id AND n.orig = h.orig
                GROUP BY u.conv_id, u.turn)
        SELECT CAST(m.conv_id AS BIGINT) AS conv_id, CAST(m.turn AS BIGINT) AS turn, coalesce(o.text, m.text) AS text
        FROM msgs m LEFT JOIN out o ON o.conv_id = m.conv_id AND o.turn = m.turn"""
    }


def sanitized_request_oracles() -> dict[str, str]:
    tools = (
        '[{"type":"function","function":{"name":"send_mail","description":"Send mail via __EMAIL_2__",'
        '"parameters":{"type":"object","properties":{"to":{"type":"string","description":"recipient, e.g. __EMAIL_1__"}}}}}]'
    )
    return {
        "chat_requests_sanitized": f"""
        WITH m AS (
          SELECT conv_id, turn,
                 '{{"role":' || to_json(role) || ',"content":'
                 || to_json(CASE WHEN turn = 0 THEN text || ' mail __EMAIL_1__' ELSE text END)
                 || CASE WHEN role = 'assistant' AND turn % 4 = 1
                         THEN ',"tool_calls":[{{"id":"c' || CAST(turn AS VARCHAR) || '","type":"function","function":{{"name":"send_mail","arguments":'
                              || to_json('{{"to":"__EMAIL_1__","n":' || CAST(turn AS VARCHAR) || '}}') || '}}}}]'
                         ELSE '' END || '}}' AS msg
          FROM conversations)
        SELECT CAST(conv_id AS BIGINT) AS conv_id,
               '{{"model":"m","messages":[' || string_agg(msg, ',' ORDER BY turn) || '],"tools":{tools}}}' AS body
        FROM m GROUP BY conv_id"""
    }


def store_oracles() -> dict[str, str]:
    insert = f"""WITH {_memories_sql()},
        new AS (SELECT DISTINCT trim(text, ' ') AS content, 'note' AS kind, CASE WHEN turn % 2 = 1 THEN 'local_only' ELSE 'anonymized' END AS egress_policy,
                       CAST(1700000000000 + conv_id * 1000 + turn AS BIGINT) AS created_ms
                FROM conversations WHERE role = 'user' AND length(trim(text, ' ')) > 0)
        SELECT id, content, kind, egress_policy, created_ms, CAST(0 AS BIGINT) AS recall_count, CAST(0 AS BIGINT) AS accessed_ms FROM mem
        UNION ALL
        SELECT substr(sha256(content || ':' || kind || ':' || CAST(created_ms AS VARCHAR)), 1, 16), content, kind, egress_policy, created_ms, 0, created_ms FROM new"""
    return {
        "memory_insert": insert,
        "vocabulary_files": """
        SELECT CAST(r AS BIGINT) AS ins, term FROM (
          SELECT 1 AS r, 'first term' AS term UNION ALL SELECT 2, 'second'
          UNION ALL SELECT 2 + row_number() OVER (ORDER BY c_custkey), c_name FROM customer WHERE c_custkey % 10 < 8)""",
        "outbound_recalls": f"{_fused_sql()} SELECT id, CAST(count(*) AS BIGINT) AS recall_count, count(*) >= 3 AS promoted FROM sel GROUP BY id",
        "canonical_requests": """
        WITH m AS (SELECT conv_id, count(*) AS n FROM (
            SELECT DISTINCT conv_id, -1 AS turn, 0 AS sub FROM conversations WHERE role = 'system' AND text <> ''
            UNION ALL SELECT conv_id, turn, 0 FROM conversations WHERE role IN ('user', 'assistant')
            UNION ALL SELECT conv_id, turn, 1 FROM conversations WHERE role = 'user' AND turn % 4 = 2 AND text <> '') GROUP BY conv_id)
        SELECT c.conv_id, 'm' AS model, CAST(coalesce(m.n, 0) AS BIGINT) AS n_messages, CAST(c.conv_id % 100 AS BIGINT) AS max_tokens, '["x"]' AS stop,
               'lookup' AS tool, '{"type":"object"}' AS parameters
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON m.conv_id = c.conv_id""",
        "block_responses": """
        SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'tool_use' ELSE 'max_tokens' END AS stop_reason,
               CASE WHEN o_orderkey % 3 = 1 THEN 'tool_use' ELSE 'text' END AS kind,
               CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'order ' || CAST(o_orderkey AS VARCHAR) END AS text,
               CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS VARCHAR) END AS order_arg,
               CAST(o_orderkey % 50 AS BIGINT) AS output_tokens
        FROM orders""",
    }
