"""Encoding, personal data, decontamination, chat and pages, against brute force and round trips."""

import hashlib
import html
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontaminate, mainpage, pii
from tidemark.llm.common import table

ODD = [None, "", " ", "\n\t", "a", "é ß Σίσυφος İ", "x" * 30_000, "wort " * 20_000, "ok", "ok"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "b", 1) for i, t in enumerate(ODD)] + [(None, "no id", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, base_sha256 int")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(bpe.default_path())
    code.no_padding()
    code.no_truncation()
    return code


def test_encoding_is_the_library_s(library, spark, sf_dir):
    code = bpe.encoder(bpe.default_path())
    texts = [r.text for r in table(spark, sf_dir, "documents").limit(60).collect()]
    for text, ids in zip(texts, code.encode_all(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert code.decode_bytes(ids).decode() == library.decode(want, skip_special_tokens=False) == code.decode(want)


def test_encoding_of_all_documents(library, spark, sf_dir):
    """Every whole text of the table, through the query's own path, against the library's digests."""
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    for r in bpe.digests(table(spark, sf_dir, "documents")).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_what_the_encoder_remembers_is_bounded():
    code = bpe.Encoder(bpe.default_path())
    rng = random.Random(3)
    for _ in range(12):
        code.encode_all([" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(30_000))])
        assert code.held <= bpe.REMEMBERED + 30_000 * (bpe.EACH + 60)


def test_ids_of_odd_documents(odd_docs):
    got = {r.doc_id: r for r in bpe.with_ids(odd_docs, ["doc_id", "n_words"]).collect()}
    code = bpe.encoder(bpe.default_path())
    for i, t in enumerate(ODD):
        want = np.frombuffer(code.encode_all([t])[0], dtype="<u4").tolist()
        assert got[i].ids == want and got[i].n_tokens == len(want) and got[i].n_words == "b"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcABZ éÉßΣς'’stЖ中١²Ⅷ½\t\n\x1c\x85  01<|endoftext|>!?_İıﬁ́😀", max_size=30), st.booleans())
def test_encoding_of_odd_texts(text, special):
    from tokenizers import Tokenizer

    library = test_encoding_of_odd_texts.__dict__.setdefault("library", Tokenizer.from_file(bpe.default_path()))
    text += "<|endoftext|>" * special
    code = bpe.encoder(bpe.default_path())
    assert np.frombuffer(code.encode_all([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_text_of_ids_gives_the_words_back():
    code = bpe.encoder(bpe.default_path())
    ids = np.frombuffer(code.encode_all(["The quick Übung, done."])[0], dtype="<u4").tolist()
    assert code.text_of(ids) == "the quick übung , done ."


def test_no_merge_crosses_a_forced_boundary():
    code = bpe.encoder(bpe.default_path())
    symbols, start, length = code.fragments(["a\x00b", "hello"])
    assert length.tolist() == [3, 5] and start[0] and start[3]
    ids, place = code.merge(symbols, start)
    assert set(np.flatnonzero(start).tolist()) <= set(place.tolist())


def test_encoding_query_of_odd_documents(odd_docs):
    got = {r.doc_id: r for r in bpe.digests(odd_docs).collect()}
    assert len(got) == len(ODD) + 1
    for i in (0, 1, 2, 3):
        assert got[i].n_tokens == 0 and got[i].ids_sha256 == got[i].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[8].ids_sha256 == got[9].ids_sha256
    assert bpe.digests(odd_docs.limit(0)).count() == 0


def base_spans(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[1])))


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="0123456789.@ab-+ ()_%é1", max_size=50))
def test_base_spans_are_those_of_the_grammar(text):
    assert [s for s in pii.find(text) if s[1] in pii.BASE] == base_spans(text)


def test_added_spans_and_redaction():
    text = "IBAN DE89 3704 0044 0532 0130 00, see https://u:p@a.example.org/x?y=1. token = \"24be64439e3e49cf\" a@b.co"
    kinds = {k: text[a:b] for a, k, b in pii.find(text)}
    assert kinds["account"] == "DE89 3704 0044 0532 0130 00" and kinds["secret"] == "24be64439e3e49cf"
    assert kinds["url"] == "https://u:p@a.example.org/x?y=1"
    assert pii.redact("write to a@b.co or +49 30 1234567!") == "write to [EMAIL] or [PHONE]!"
    assert pii.redact("nothing here") == "nothing here" and pii.redact(None) is None and pii.find(None) == []


def test_detection_of_odd_documents(odd_docs, spark, sf_dir):
    assert {r.n_email for r in pii.detect(odd_docs).collect()} == {0}
    got = {r.doc_id: r for r in pii.detect(table(spark, sf_dir, "documents")).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        want = base_spans(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in want).encode()).hexdigest()


def brute_contamination(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    w, hit, named = split(text), set(), []
    for name, item in items:
        some = False
        b = split(item)
        m = min(10, len(b))
        for k in range(len(b) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == b[k : k + m]:
                    hit |= set(range(i, i + m))
                    some = True
        if some:
            named.append(name)  # once for each item, as several may have one id
    return len(w), len(hit), sorted(named)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def all_matches(text, items):
    """(word of the text, words) of every stretch that an item has too and that can't be made longer to the right."""
    w, out = plain_words(text), set()
    for _, item in items:
        b = plain_words(item)
        for i in range(len(w)):
            for j in range(len(b)):
                n = 0
                while i + n < len(w) and j + n < len(b) and w[i + n] == b[j + n]:
                    n += 1
                if b and (n >= 10 or j == 0 and n == len(b)):
                    out.add((i, n))
    return out


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_decontamination_is_brute_force_s(spark, block_words):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 3, 9, 10, 11, 25])))) for i in range(12)] + [(99, None), (100, "?!"), (7, "w1 w2")]
    texts = [" ".join(rng.choices(vocab, k=60)) for _ in range(30)] + [items[k][1] + " x " + items[k][1].upper() for k in range(12)] + ODD
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block_words=block_words).collect()}
    for i, t in enumerate(texts):
        if t is None or len(t) < 10_000:
            n, hit, named = brute_contamination(t or "", [(str(a), b or "") for a, b in items])
            assert (got[i].n_words, got[i].n_hit, got[i].contaminated) == (n, hit, hit > 0), t
            assert got[i].n_items == len(named) and got[i].items_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
            assert got[i].longest == max((n for *_, n in all_matches(t or "", items)), default=0)
    kept = {r.doc_id for r in decontaminate.remove_contaminated(docs, bench, block_words=block_words).collect()}
    assert kept == {i for i, r in got.items() if not r.contaminated}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_longest_matches_have_their_places(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b " + " ".join(item.split()[5:20]) + " c"), (2, item), (3, "q1 q2")], "doc_id long, text string")
    bench = spark.createDataFrame([(8, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got == {(1, "8", 2, 5, 15), (2, "8", 0, 0, 30)}


def test_longest_matches_are_those_that_none_covers(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([2, 9, 12, 40])))) for i in range(8)]
    items += [(20, items[3][1]), (21, items[7][1] + " w1")]
    cut = lambda: (lambda w: " ".join(w[rng.randrange(5) : len(w) - rng.randrange(5)]))(rng.choice(items)[1].split())
    texts = [" x ".join(cut() for _ in range(4)) + " " + " ".join(rng.choices(vocab, k=20)) for _ in range(25)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.longest_matches(docs, bench).collect()
    held = {str(i): plain_words(t) for i, t in items}
    for doc, text in enumerate(texts):
        own, found, want = plain_words(text), all_matches(text, items), set()
        for a, n in found:
            if not any((x, m) != (a, n) and x <= a and a + n <= x + m for x, m in found):
                want.add((a, n))
        mine = [r for r in got if r.doc_id == doc]
        assert {(r.doc_word, r.n_words) for r in mine} == want and len(mine) == len(want)
        assert all(own[r.doc_word : r.doc_word + r.n_words] == held[r.item_id][r.item_word : r.item_word + r.n_words] for r in mine)


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (30, 2), (200, 1), (300, 5)):
        x = np.append(rng.integers(1, k + 1, n), -1)
        assert decontaminate.suffix_array(x).tolist() == sorted(range(n + 1), key=lambda i: x[i:].tolist())


def test_texts_and_items_that_share_a_passage_are_not_paired():
    passage = [f"p{i}".encode() for i in range(10)]
    t = time.perf_counter()
    block = decontaminate.Block([(str(i), [b"a%d" % i, *passage, b"z%d" % i]) for i in range(2000)])
    told = {}
    rows = decontaminate.judged([[b"x%d" % i, *passage] for i in range(3000)], block, told)
    assert {r[1:3] + r[4:] for r in rows} == {(10, 2000, True, 10)} and len(told) == 1
    assert time.perf_counter() - t < 10


CONTROLS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "\n", "ab", "é", ""]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>"]), CONTROLS), max_size=5))
def test_conversations_are_read_back(turns):
    pack = chat.Pack()
    pack.add(0, turns[:2])
    pack.add(1, turns)
    pack.add(2, turns)
    row = pack.row().to_pylist()[0]
    for leaf, want in zip(row["conversations"], (turns[:2], turns, turns)):
        whole, got, learned = chat.read(row["text"], row["nodes"], leaf["leaf"])
        assert got == want and learned == "".join(t for r, t in want if r == "assistant")
        assert whole == "".join(chat.formatted(*t)[0] for t in want)
    assert len(row["nodes"]) == len(turns)  # shared turns are there once
    for c in chat.CONTROL[3:]:
        assert c not in row["text"]


def test_positions_and_intervals():
    pack = chat.Pack()
    a, b, c = ("user", "hi"), ("assistant", "one"), ("assistant", "two")
    pack.add(0, [a, b, a])
    pack.add(1, [a, c])
    row = pack.row().to_pylist()[0]
    first, second, third, fourth = row["nodes"]
    assert third["attends"] == [{"start": 0, "end": second["end"]}]
    assert fourth["attends"] == [{"start": 0, "end": first["end"]}] and fourth["position"] == first["end"] and fourth["start"] == third["end"]


def test_chat_query_with_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, None, "x"), (2, None, "user", "y")]
    rows += [(100 + i, 0, "user", "same") for i in range(50)] + [(None, 1, "assistant", "z"), (7, 0, "assistant", "long " * 100_000)]
    table_ = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, path string")
    all_ = chat.read_back(chat.packed(table_, most=100)).collect()
    got = {r.conv_id: r for r in all_ if r.conv_id is not None or r.loss_chars == 0}
    assert len(all_) == 55 and len(got) == 54 and sorted(r.loss_chars for r in all_ if r.conv_id is None) == [0, 1]
    assert got[7].loss_chars == 500_000
    assert got[1].n_turns == 4 and got[1].loss_chars == 3
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\na\nassistant\na\nassistant\nb\n").hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest()
    assert chat.read_back(chat.packed(table_.limit(0))).count() == 0


def test_pages_give_their_articles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = {r.page_id: r.text for r in mainpage.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.DOTALL)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", inner)).split())


def nameless(page):
    """A page without the tags, classes and ids that name a role."""
    page = re.sub(r"<(/?)(?:article|main|nav|aside|header|footer|form|section)\b", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_pages_whose_elements_name_no_role(spark, sf_dir):
    """Precision and recall of words where only the text and the tree tell content from the rest."""
    pages = [r.html for r in table(spark, sf_dir, "pages").collect()]
    weights = mainpage.fit(pages)
    right = found = wanted = 0
    for page in pages:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
        want = Counter(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", inner)).split())
        got = Counter(mainpage.main_text(nameless(page), weights)[0].split())
        right, found, wanted = right + (want & got).total(), found + got.total(), wanted + want.total()
    assert right / found > 0.85 and right / wanted > 0.95, (right / found, right / wanted)


def test_contents_that_are_no_forms_or_scripts_stay():
    weights = mainpage.fit([])
    page = "<article><p>Let <math>x=1</math> hold, <object>shown instead</object> and more.</p><noscript><p>Some more words, read without scripts.</p></noscript><select><option>A</select><button>Go</button></article>"
    assert mainpage.main_text(page, weights)[0] == "Let x=1 hold, shown instead and more. Some more words, read without scripts."


def test_deep_and_long_pages_take_time_in_proportion():
    def seconds(n):
        t = time.perf_counter()
        mainpage.main_text("<div><p>Some words of a sentence that is long enough.</p>" * n + "</div>" * n, mainpage.PRIOR)
        return time.perf_counter() - t

    seconds(500)
    small = min(seconds(2000) for _ in range(3))
    assert min(seconds(8000) for _ in range(2)) < 10 * small  # 16 times would be quadratic


def test_odd_pages(spark):
    weights = mainpage.fit([])
    page = (
        "<html><head><title>T</title><script>if (a<b) x='</p>';</script></head><body><div class='cookie-notice'>We use cookies.</div><header>Site</header>"
        "<nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><main><h1>Head &amp; line</h1><p>First <b>bold</b>\n text, long enough to be read.<p>Second one<br>goes on here, also long."
        "<aside>See also</aside><form>Name <input></form></main><div id=comments><p>A reader says something quite long here.</p></div><footer>Foot</footer>"
    )
    assert mainpage.main_text(page, weights)[0] == "Head & line First bold text, long enough to be read. Second one goes on here, also long."
    odd = [None, "", "<", "<!-- never closed", "<p", "<script>x", "</p></div>", "&amp", "<div " + "x" * 10_000]
    df = spark.createDataFrame([(i, "u", p, 3) for i, p in enumerate(odd)], "page_id long, url string, html string, n_chars int")
    assert mainpage.extract(df).count() == len(odd)
    assert mainpage.extract(df.limit(0)).count() == 0


def test_minimum_cut_is_the_best_labelling():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        a, b = rng.random(n) * 3, rng.random(n) * 3
        joins = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(b[i] if side[i] else a[i] for i in range(n)) + sum(w for i, j, w in joins if side[i] != side[j])

        best = min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert cost(mainpage.minimum_cut(a, b, joins)) == pytest.approx(best)


def test_redacted_column_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a@b.co")], "doc_id long, text string").select(pii.redacted()(F.col("text")).alias("t"))
    assert sorted(str(r.t) for r in df.collect()) == ["None", "[EMAIL]"]


def test_personal_data_takes_time_in_proportion():
    for unit in ("http://", "http://a:", "+1", "a@b", "1.", "token=", "4 ", "DE12 ", "://"):
        t = time.perf_counter()
        pii.find(unit * ((1_000_000 if "http" in unit else 200_000) // len(unit)))
        assert time.perf_counter() - t < 8, unit  # quadratic would take minutes


def test_check_sums_are_taken_only_where_a_word_ends(monkeypatch):
    asked = []
    monkeypatch.setattr(pii, "_iban", lambda plain: asked.append(plain))
    pii.find("DE12 " * 7)
    assert len(asked) <= 7 * 7, len(asked)
    assert all(len(x) % 4 == 0 for x in asked)


def urls_by_hand(text):
    """Each scheme in turn, its run read anew."""
    out, used = [], 0
    for m in re.finditer(r"(?<=:)//", text):
        at = m.start() - 1
        s = pii.SCHEME.search(text, max(used, at - 5), at)
        r = pii.LINK.match(text, at + 3)
        if s and r:
            end = at + 3 + len(r[0].rstrip(".,;:!?)]"))
            if "." in text[at + 3 : end] or text.startswith("localhost", at + 3):
                out.append((s.start(), "url", end))
                used = end
    return out


def test_links_are_those_of_reading_each_scheme_anew():
    rnd = random.Random(3)
    parts = ["http://", "https://", "ftp://", "://", "a", "b.c", ".", "...", ")", " ", "localhost", "x/", "<", "://http://"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9)))
        assert [x for x in pii.find(text) if x[1] == "url"] == urls_by_hand(text), text


def test_equal_rows_without_a_conversation_are_dealt_out(spark):
    rows = [(None, 0, "user", "the same text")] * 6000 + [(i, 0, "user", "hello") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    packs = chat.packed(df, partitions=8, most=5000).withColumn("range", F.spark_partition_id())
    sizes = [r.n for r in packs.groupBy("range").agg(F.sum(F.size("conversations")).alias("n")).collect()]
    assert sum(sizes) == 6050 and len(sizes) >= 6 and max(sizes) < 2000
    assert chat.read_back(packs.drop("range")).count() == 6050
    assert chat.ranges(df, 1000) > chat.ranges(df, 10**9) == int(spark.conf.get("spark.sql.shuffle.partitions"))
