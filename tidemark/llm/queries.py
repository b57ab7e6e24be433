"""The registered queries of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, capfilter, chat, chunks, decontaminate, langid, mainpage, middle, minhash, pii, quality, spelling, toxicity
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mainpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpage.extract(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, whose texts are control strings."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], conversations.schema)
    return chat.read_back(chat.packed(conversations.union(more)))


def op8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.deduplicate(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_capfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.similar_vectors(table(spark, sf_dir, "embeddings"))


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_mainpage": op5_mainpage,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat": op7_chat,
    "op8_chunks": op8_chunks,
    "op9_minhash": op9_minhash,
    "op10_capfilter": op10_capfilter,
    "op11_middle": op11_middle,
    "op12_spelling": op12_spelling,
    "op13_langid": op13_langid,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL: dict[str, str] = {
    "op6_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        starts AS (SELECT item, item_id, least(len(w), 10) AS m, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM b WHERE len(w) > 0),
        windows AS (SELECT item, item_id, m, j, w[j:j + m - 1] AS win FROM starts),
        sizes AS (SELECT DISTINCT m FROM windows),
        places AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, sizes WHERE len(w) >= m),
        found AS (SELECT p.doc_id, p.i, p.m, x.item, x.item_id, x.j FROM (SELECT doc_id, i, m, w[i:i + m - 1] AS win FROM places) p JOIN windows x ON p.win = x.win),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item, item_id FROM found) GROUP BY doc_id),
        runs AS (SELECT doc_id, item, item_id, i, j, m, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS run FROM found),
        longest AS (SELECT doc_id, count(*) + any_value(m) - 1 AS n FROM runs GROUP BY doc_id, item, item_id, i - j, run),
        told AS (SELECT doc_id, max(n) AS longest FROM longest GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
            coalesce(longest, 0)::BIGINT AS longest
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN told USING (doc_id)""",
    "op7_chat": f"""
        WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(chat.START + chat.MESSAGE + chat.END)})::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id, own""",
    "op9_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS s FROM d),
        sh AS (SELECT doc_id, unnest(s) AS x FROM s),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
        e AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.v FROM reach r JOIN e ON r.seen = e.u),
        c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.node = s.doc_id""",
    "op10_capfilter": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        fit AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.v FROM reach r JOIN link l ON r.seen = l.u),
        c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
        n AS (SELECT u, count(*) AS n_links FROM link GROUP BY u)
        SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.u = v.vec_id""",
    "op11_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_spelling": f"""
        WITH RECURSIVE bit AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b)),
        crc AS (SELECT list(v ORDER BY b) AS c FROM bit),
        runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
        coded AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs),
        hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda s, y: xor(s >> 8, c[(xor(s, y) & 255) + 1]))) AS h FROM coded, crc),
        told AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed),
        v AS (SELECT w AS word, sum(n)::BIGINT AS n FROM told WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
        cut AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM v),
        holes AS (SELECT word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) AS hole FROM cut),
        less AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS rest FROM cut),
        near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
            UNION ALL SELECT l.word, l.n, v.word, v.n FROM less l JOIN v ON l.rest = v.word UNION ALL SELECT v.word, v.n, l.word, l.n FROM less l JOIN v ON l.rest = v.word),
        best AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY 1, 2),
        forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms f ON f.word = walk.next)
        SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word AND walk.next IS NULL""",
}
