"""Fill-in-the-middle, spelling variants and languages against brute force, and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, middle, spelling
from tidemark.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


# ---- fill-in-the-middle

TEXTS = ["", "a", "ab\ncd  ef\n\n", "😀éx𝄞 1,234 été\r\n", "\n\n", "  lead", "<P>x", "a<M", "x" * 3000, " a\u0085b", "<S"]


@pytest.mark.parametrize("name", sorted(middle.GRAMMARS))
def test_units_put_together_are_the_text(spark, name):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", middle.units(F.col("t"), middle.GRAMMARS[name]).alias("u")).collect():
        assert "".join(r.u) == r.t and "" not in r.u


def test_units_are_those_of_the_grammar(spark):
    df = spark.createDataFrame([("ab\ncd  éf12.\n\n😀x",)], "t string")
    want = {
        "chars": list("ab\ncd  éf12.\n\n😀x"), "words": ["ab\n", "cd  ", "éf12.\n\n", "😀x"], "lines": ["ab\n", "cd  éf12.\n", "\n", "😀x"],
        "runs": ["ab", "\n", "cd", "  ", "éf", "12", ".", "\n\n", "😀", "x"],
    }
    got = df.select(*(middle.units(F.col("t"), g).alias(n) for n, g in middle.GRAMMARS.items())).first().asDict()
    assert got == want


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def test_middle_is_as_by_hand_and_reads_back(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] * (1 + i % 3)) for i in range(-20, 300)] + [(None, "abc"), (None, None), (7, "again"), (7, "again"), (2**62, "big")]
    out = middle.fill_in_middle(docs(spark, *rows)).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    got = Counter((r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.output) for r in out.collect())
    assert got == Counter((i, t or "", *by_hand(i, t)) for i, t in rows)
    assert out.where("back != text").isEmpty() and {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_middle_of_lines_keeps_lines_whole(spark):
    rows = [(i, "one\ntwo\n\nthree\nfour") for i in range(200)]
    for r in middle.fill_in_middle(docs(spark, *rows), middle.GRAMMARS["lines"]).where("form != 'plain'").collect():
        assert r.n == 5 and all(not x or x.endswith("\n") or x.endswith("four") for x in (r.prefix, r.middle)) and r.prefix + r.middle + r.suffix == r.text


def test_middle_of_nothing_and_of_clashing_columns(spark):
    assert middle.digests(docs(spark)).count() == 0
    odd = docs(spark, (1, "abc def")).withColumns({c: F.lit("x") for c in ("n", "form", "prefix", "output", "_units", "_a")})
    assert middle.digests(odd).collect() == middle.digests(docs(spark, (1, "abc def"))).collect()


def test_a_mark_across_an_edge_is_none(spark):
    rows = [(i, "a<P<S<M>x"[: 2 + i % 6]) for i in range(400)]
    out = middle.fill_in_middle(docs(spark, *rows))
    assert out.where(middle.restored(F.col("output"), F.col("form")) != F.col("text")).isEmpty()


# ---- spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelled_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def test_neighbours_in_a_trie_are_all_words_one_edit_away_each_once():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abzàÿ") for _ in range(rnd.randint(1, 6))) for _ in range(700)} | {"a" * n for n in range(1, 9)} | {"bbaabb", "bbabb", "ÿ" * 40})
    known = [w.encode("latin-1") for w in words]
    half = [w for i, w in enumerate(known) if i % 3]
    reader = spelling.Reader(spelling.Trie.unpacked(spelling.Trie.of(half[::-1], list(range(len(half)))).packed()))
    found = [(known[i].decode("latin-1"), reader.spelled(k)) for place, word in reader.neighbours(known) for i, k in zip(place, word)]
    want = {(a, b.decode("latin-1")) for a in words for b in half if one_apart(a, b.decode("latin-1"))}
    assert len(found) == len(set(found)) and set(found) == want


def made_texts(seed, n=120):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(5, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(60):
            w = base[int(40 * rnd.random() ** 3)]
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abÿ") + w[k:], w[:k] + "z" + w[k + 1 :]])
            out.append(w.upper() if rnd.random() < 0.1 and w.isascii() else w)
        rows.append((i, " ".join(out)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_as_by_hand_in_many_shards_and_passes(spark, monkeypatch, seed):
    monkeypatch.setattr(spelling, "SHARD_BYTES", 100)
    monkeypatch.setattr(spelling, "REMEMBERED", 50)
    rows = made_texts(seed) + [(None, "chains chains chains chains chains"), (None, None), (3, ""), (4, "a"), (5, "zzzzzzzz " * 400 + "zzzzzzz " * 70 + "zzzzzz " * 9), (5, "zzzzzz")]
    calls, real = [], spelling.passes
    monkeypatch.setattr(spelling, "passes", lambda sizes: calls.append(real(sizes, 250)) or calls[-1])
    got = [tuple(r) for r in spelling.variants(docs(spark, *rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == spelled_by_hand(rows)
    assert len(calls[0]) > 2 and {("zzzzzz", "zzzzzzz", "zzzzzzzz", 10)} <= {r[:4] for r in got}


def test_spelling_of_odd_tables(spark):
    assert spelling.variants(docs(spark)).count() == 0
    assert spelling.variants(docs(spark, (1, None), (2, ""), (3, "short words only"))).count() == 0
    long = "q" * 5000
    rows = [(i, f"{long} {long}x ÀÉÎõü àÉÎõü×") for i in range(5)]
    odd = docs(spark, *rows).withColumns({c: F.lit("x") for c in ("word", "n", "form", "root")})
    assert {tuple(r) for r in spelling.variants(odd).select("word", "form", "root", "n", "n_near", "form_n").collect()} == spelled_by_hand(rows)


def test_passes_hold_what_they_may():
    assert spelling.passes([]) == [] and spelling.passes([(1, 5), (2, 5), (3, 9), (4, 50), (5, 1)], 10) == [[1, 2], [3], [4], [5]]


# ---- languages


def test_vectors_do_not_depend_on_the_texts_beside_them():
    texts = [b"", b" ", "Été à l'école".encode(), b"x", b"12 3", "ä" .encode() * 3000, b" lead and trail ", b"\xff\xfe bad", "日本語".encode(), b"a-b"]
    together = np.concatenate([x for x, _ in langid.features(texts)])
    alone = np.concatenate([x for t in texts for x, _ in langid.features([t])])
    assert np.array_equal(together, alone) and np.array_equal(together, np.concatenate([x for x, _ in langid.features(texts[::-1])])[::-1])
    seen = np.concatenate([s for _, s in langid.features(texts)])
    assert seen.tolist() == [False, False, True, True, False, True, True, True, True, True]


def test_vectors_count_all_sequences_and_words():
    x, _ = next(langid.features([b"ab ab, b"]))
    # a b | ab (twice), edge pairs "b ", " a" ..., and words: by hand through the same hash of single texts
    one, _ = next(langid.features([b"zq"]))
    assert np.count_nonzero(one) in range(4, 8) and abs((x**2).sum() - 1) < 1e-12 and np.count_nonzero(x) > np.count_nonzero(one)


def test_whole_texts_count():
    head = b"the of and " * 4000
    a, b = (next(langid.features([t]))[0] for t in (head, head + b"xylophone"))
    assert not np.array_equal(a, b)


def test_a_machine_separates_and_its_chances_are_near_the_truth():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((600, 30)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rnd.standard_normal(600) > 0, 1, -1).astype(np.float32)
    w = langid.machine(x, y)
    best, chance = langid.decided(x.astype(float), ["p", "n"], [("p", "n", w)])
    assert np.mean((best == 0) == (y > 0)) > 0.85 and 0.8 < chance.mean() <= 1
    loss = lambda v: 0.5 * (v**2).sum() + langid.COST * (0.5 * 600 * (np.maximum(1 - y * (np.column_stack([x, np.ones(600)]) @ v), 0) ** 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum()))).sum()
    v = w[:-2]
    assert all(loss(v) <= loss(v + step) for step in 0.05 * rnd.standard_normal((200, 31)))


def test_votes_decide_between_more_than_two():
    w = lambda k: np.append(np.eye(3)[k], [0.0, 1.0, 0.0])  # noqa: E731  (the chance of the first grows with feature k)
    best, chance = langid.decided(np.array([[5.0, 5, 0], [-5, 0, 5], [0, -5, -5]]), ["a", "b", "c"], [("a", "b", w(0)), ("a", "c", w(1)), ("b", "c", w(2))])
    assert best.tolist() == [0, 1, 2] and (chance > 0.9).all()


def test_held_out_languages_are_found_and_not_learned_from(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.99 * found.count() and found.where("score < 0 or score > 1").isEmpty()
    hidden = d.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.languages(x).collect()} for x in (d, hidden.repartition(5)))
    assert a == b


def test_languages_of_odd_tables(spark):
    assert langid.languages(docs(spark)).count() == 0
    none = langid.languages(docs(spark, (1, "text"), (2, None))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    learnable = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "the house is old", "en") for i in learnable[:20]] + [(500, "1234 ... !"), (501, None), (502, "́"), (None, "the house"), (None, "the house"), (503, "")]
    one = langid.languages(docs(spark, *rows).withColumns({c: F.lit("x") for c in ("lang_pred", "place", "drawn", "vector", "side", "family")})).collect()
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in one}
    assert len(one) == len(rows) and by_id[learnable[0]] == by_id[None] == ("en", 1.0) and all(by_id[i] == ("und", 0.0) for i in (500, 501, 502, 503))


def test_families_and_several_languages(spark):
    assert [langid.family(x) for x in ("en", "pt-BR", "zz")] == ["germanic", "romance", "of zz"]
    learnable = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    says = {"en": "the of and with", "de": "der und nicht mit", "nl": "het een niet van", "fr": "les des une dans", "es": "los una del por", "zz": "qxq kzk wvw"}
    rows = [(learnable[k * 30 + i], f"{t} {i}", lang) for k, (lang, t) in enumerate(says.items()) for i in range(30)] + [(10_000 + k, t) for k, t in enumerate(says.values())]
    got = {r.doc_id: (r.lang_pred, r.family) for r in langid.languages(docs(spark, *rows)).collect()}
    assert [got[10_000 + k] for k in range(6)] == [(lang, langid.family(lang)) for lang in says]
