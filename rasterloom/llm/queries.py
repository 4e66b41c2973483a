"""The subpackage's registry: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from rasterloom.llm import byte_bpe, chat, embedding_dedup, jaccard, langid, lm, mixing, packing, quality, secrets, toxicity, vector_codes

QUERIES = {
    "op2_lm": lm.op2_lm,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op5_jaccard": jaccard.op5_jaccard,
    "op10_chat": chat.op10_chat,
    "op1_mixing": mixing.op1_mixing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op3_secrets": secrets.op3_secrets,
    "op7_langid": langid.op7_langid,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
}
_REACH = """, reach AS (SELECT id, id AS c FROM nodes UNION SELECT l.b AS id, reach.c FROM reach JOIN links l ON l.a = reach.id), comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY 1)"""



def _codes_sql() -> str:
    """Two rounds of assignment and means written out; a distance and an entry's index are told by one number, so that ties go to the lower index."""
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = f"SELECT id, p.part, any_value(p.x) AS x, min({far} * 64 + b.entry) AS m FROM p JOIN {{books}} b ON b.part = p.part GROUP BY 1, 2"
    mean = "SELECT part, entry, list(v ORDER BY pos) AS x FROM (SELECT part, m % 64 AS entry, pos, floor(sum(x[pos]) / count(*))::BIGINT AS v FROM {near}, range(1, (SELECT max(len(x)) FROM p) + 1) r(pos) GROUP BY 1, 2, 3) GROUP BY 1, 2"
    rounds = "".join(
        f", a{k} AS MATERIALIZED ({near.format(books=f'b{k}')}), n{k} AS ({mean.format(near=f'a{k}')}), b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN n{k} n ON n.part = b.part AND n.entry = b.entry)"
        for k in range(2)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT id, row_number() OVER (ORDER BY vec_id, q) - 1 AS entry FROM v WHERE vec_id IS NOT NULL QUALIFY entry < 64),
p AS MATERIALIZED (SELECT id, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS x FROM v, range(16) r(part)),
b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN s USING (id)){rounds},
e AS (SELECT id, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM ({near.format(books="b2")}) GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (id), h"""


#: Brute force over all pairs; the other operators learn or search in ways that SQL can't express and are tested in tests/llm.
ORACLE: dict[str, str] = {
    "op5_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT w.doc_id AS id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1), nodes AS (SELECT id FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), links AS (SELECT a, b FROM l UNION SELECT b, a FROM l)"""
    + _REACH
    + " SELECT id AS doc_id, n AS n_shingles, component_id FROM n JOIN comp USING (id)",
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings), nodes AS (SELECT id FROM v),
links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9)"""
    + _REACH
    + " SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM comp",
    "op11_vector_codes": _codes_sql(),
}
