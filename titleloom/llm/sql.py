"""Reference SQL of the registered queries, where SQL can express them."""

from titleloom.llm import chat, collocations, decontaminate, merkle, mixing, neighbours, topk

_RESERVED = "|".join(
    c[0].replace("[", "\\[") + "\\\\*" + "".join("\\" + x if x in "|[]/<>" else x for x in c[1:]) for c in chat.CONTROL_STRINGS
)

OP4 = f"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, len(regexp_extract_all(text, '{_RESERVED}')) + len(regexp_extract_all(role, '{_RESERVED}')) AS extra FROM talks
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
  sum(length(role) + length(text) + extra + {len(chat.TURN + chat.TEXT + chat.END) + 1})::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP2 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight,
    source_size * {mixing.MOST} AS cap FROM sums
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0))::DOUBLE / (sum(weight) OVER above)::DOUBLE AS level FROM weighed
  WINDOW below AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         above AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce(max(CASE WHEN cap > level * weight THEN level END) OVER () * weight, cap::DOUBLE)) AS target FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 13))::BIGINT / {float(1 << 52)} AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), drawn AS (
  SELECT *, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM drawn
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_W = decontaminate.WINDOW

OP3 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), {_W}) AS n, array_to_string(w[p:p + least(len(w), {_W}) - 1], ' ') AS x
  FROM i, unnest(range(1, len(w) - least(len(w), {_W}) + 2)) AS t(p) WHERE len(w) > 0
), doc_windows AS (
  SELECT row, p, n, array_to_string(w[p:p + n - 1], ' ') AS x
  FROM d, (SELECT DISTINCT n FROM item_windows) AS lengths, unnest(range(1, len(w) - n + 2)) AS t(p)
), found AS (
  SELECT row, p, n, item FROM doc_windows JOIN item_windows USING (n, x)
), hit AS (
  SELECT row, count(DISTINCT q)::BIGINT AS n_hit FROM found, unnest(range(p, p + n)) AS t(q) GROUP BY row
), named AS (
  SELECT row, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

OP9 = f"""
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % {topk.QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {topk.K}
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in merkle.FIELDS) + ")"
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_A = merkle.ARITY

OP11 = f"""
WITH RECURSIVE changed AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC} % {merkle.TAMPER_EVERY} = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars::HUGEINT END AS told FROM documents
), digests AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "told")} AS claim, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM changed
), leaves AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM digests
), tree AS (
  SELECT g, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // {_A}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {_A - 1}) // {_A} FROM tree WHERE n > 1 GROUP BY g, level, pos // {_A}, n
), subroots AS (
  SELECT g, digest FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS level, g AS pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // {_A}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {_A - 1}) // {_A} FROM upper WHERE n > 1 GROUP BY level, pos // {_A}, n
), steps AS (
  SELECT row, level AS step, string_agg(digest, '' ORDER BY t.pos) FILTER (t.pos < own) AS before, string_agg(digest, '' ORDER BY t.pos) FILTER (t.pos > own) AS after
  FROM (SELECT l.row, l.g, t.level, t.pos, t.digest, l.pos // pow({_A}, t.level)::BIGINT AS own FROM leaves l JOIN tree t ON l.g = t.g AND t.n > 1 AND l.pos // pow({_A}, t.level + 1)::BIGINT = t.pos // {_A}) t
  GROUP BY row, level
  UNION ALL
  SELECT row, 1000 + level, string_agg(digest, '' ORDER BY t.pos) FILTER (t.pos < own), string_agg(digest, '' ORDER BY t.pos) FILTER (t.pos > own)
  FROM (SELECT l.row, t.level, t.pos, t.digest, l.g // pow({_A}, t.level)::BIGINT AS own FROM leaves l JOIN upper t ON t.n > 1 AND l.g // pow({_A}, t.level + 1)::BIGINT = t.pos // {_A}) t
  GROUP BY row, level
), ordered AS (
  SELECT row, coalesce(before, '') AS before, coalesce(after, '') AS after, row_number() OVER (PARTITION BY row ORDER BY step) AS k FROM steps
), proofs AS (
  SELECT row, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256, max(k) AS height FROM ordered GROUP BY row
), folded AS (
  SELECT row, 0 AS k, claim AS digest FROM leaves
  UNION ALL
  SELECT f.row, o.k, sha256(o.before || f.digest || o.after) FROM folded f JOIN ordered o ON f.row = o.row AND o.k = f.k + 1
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON l.g = s.g JOIN (SELECT digest FROM upper WHERE n = 1) r ON true
LEFT JOIN proofs p ON l.row = p.row JOIN folded f ON f.row = l.row AND f.k = coalesce(p.height, 0)
"""

OP12 = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT row, vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.row AS one, b.row AS two FROM good a JOIN good b ON a.row <> b.row AND list_cosine_similarity(a.e, b.e) >= {neighbours.LEAST}
), reach AS (
  SELECT row, row AS other FROM v
  UNION
  SELECT reach.row, links.two FROM reach JOIN links ON reach.other = links.one
), least AS (
  SELECT reach.row, min(vec_id) AS component_id FROM reach JOIN v ON v.row = reach.other GROUP BY reach.row
), counts AS (
  SELECT one AS row, count(*) AS n_links FROM links GROUP BY one
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (row) LEFT JOIN counts USING (row)
"""

_C = collocations
OP13 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), counts AS (
  SELECT lang, len, array_to_string(w[p:p + len - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM worded, unnest(range(1, {_C.LONGEST} + 1)) AS l(len), unnest(range(1, len(w) - len + 2)) AS t(p) GROUP BY lang, len, phrase
), cand AS (
  SELECT lang, len, phrase, f AS a FROM counts WHERE len > 1 AND f >= {_C.LEAST}
), inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[p:p + k - 1], ' ') AS phrase, max(a) AS cover
  FROM cand, unnest(range(2, len)) AS s(k), unnest(range(1, len - k + 2)) AS t(p) GROUP BY 1, 2
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM cand LEFT JOIN inside USING (lang, phrase), unnest(range(1, len)) AS s(k)
  WHERE cover IS NULL OR 100 * cover::HUGEINT < {_C.NEARLY} * a
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, ({_C.SCALE}::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = tail
), best AS (
  SELECT lang, phrase, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS b FROM scored GROUP BY lang, phrase, a
), flat AS (
  SELECT lang, phrase, a, b.l AS l, b.r AS r, b.score AS score FROM (SELECT lang, phrase, a, b FROM best)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM flat
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {_C.TOP}
"""

ORACLES: dict[str, str] = {"op2_mixing": OP2, "op3_decontamination": OP3, "op4_chat": OP4, "op9_topk": OP9, "op11_merkle": OP11, "op12_embedding_near_dedup": OP12, "op13_collocations": OP13}
