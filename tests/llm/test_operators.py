"""Operators against brute force, with nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lithos.llm import buckets, common, decontaminate, language, lines, minhash, neighbours, packing, pages, sharding, suffixes, urls
from lithos.llm.components import connected_components
from lithos.llm.tokens import WordTokenizer

WORDS = [f"w{i}" for i in range(400)]
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, a int")


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def near(spark):
    rng, rows = random.Random(1), []
    for g in range(8):
        base = words(rng, 120)
        for _ in range(22 if g == 0 else 3):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append(" ".join(own))
    rows += [" ".join(words(rng, 50)), "one two", "one two", "", None, "!!", "!!", " ".join(["la"] * 90), " ".join(["la"] * 100)]
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, near):
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(docs_of(spark, near), "doc_id", "text").collect()}
    bag = {}
    for i, t in near:
        w = (t or "").split()
        s = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w and t != "!!" else []
        bag[i] = {(x, s[:j].count(x)) for j, x in enumerate(s)}
    root = {i: i for i, _ in near}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, t in near:
        for j, u in near:
            if i < j and ((bag[i] and bag[j] and len(bag[i] & bag[j]) >= 0.8 * len(bag[i] | bag[j])) or (t == u == "!!")):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i, _ in near}


def test_bags_of_very_many_occurrences_are_linked(spark):
    rows = [(1, "a " * 100_004), (2, "a " * 100_005), (3, "a " * 70_000)]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(docs_of(spark, rows), "doc_id", "text").collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    s = np.arange(1, 201, dtype=np.uint64) * np.uint64(7919)
    a, b = rng.integers(1, 9, 200), rng.integers(1, 9, 200)
    sig = minhash.signatures(np.concatenate([s, s]), np.concatenate([a, b]), np.array([0, 200, 400]), 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (5, 5), (None, 4), (8, 7)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (9, 7), (8, 7), (7, 7), (5, 5)}
    assert connected_components(edges.where("false"), "a", "b").count() == 0


def test_repeated_lines_go(spark):
    long = "the quick brown fox jumps over the lazy dog near the river bank today again and again"
    rows = [(2, f"{long}\nshort one"), (1, f"{long.upper()}!\nfirst"), (3, f"new\n{long.replace('dog', 'cat')}\n\nshort one"), (4, None), (5, ""), (None, long), (6, long), (6, long)]
    got = {(r.doc_id, r.text, r.n_removed) for r in lines.dedupe_lines(docs_of(spark, rows), "doc_id", "text").collect()}
    assert (1, f"{long.upper()}!\nfirst", 0) in got and (2, "short one", 1) in got and (6, "", 1) in got
    assert {(4, None, 0), (5, "", 0), (None, long, 0)} <= got
    assert lines.dedupe_lines(docs_of(spark, rows).where("false"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("small", [1, 16])
def test_bucket_size_does_not_decide_lines(spark, monkeypatch, small):
    monkeypatch.setattr(buckets, "SMALL", small)
    one = "gqk hgo yqj cxhwbl yekj pko fdkq xelr te lsil pm yzlcat"
    df = docs_of(spark, [(1, one), (2, one.replace("te lsil", "lvxv lsil"))])
    assert [tuple(r) for r in lines.duplicate_lines(df, "doc_id", "text").collect()] == [(2, 0)]


def fuzzy_lines(rng, sizes, share):
    """Pairs of lines; in the second one `share` of the words are others."""
    made = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    out = []
    for n in sizes:
        a = [made() for _ in range(n)]
        b = list(a)
        for i in rng.sample(range(n), max(1, int(share * n))):
            b[i] = made()
        out.append((" ".join(a), " ".join(b)))
    return out


def edit_similarity(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return 1 - last[-1] / max(len(a), len(b))


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_planted_fuzzy_lines_are_found(spark, share):
    pairs = fuzzy_lines(random.Random(7), [6, 10, 20, 40] * 25, share)
    df = docs_of(spark, [(2 * i + j, x) for i, pair in enumerate(pairs) for j, x in enumerate(pair)])
    got = {r.doc_id // 2 for r in lines.duplicate_lines(df, "doc_id", "text").collect()}
    want = {i for i, (a, b) in enumerate(pairs) if edit_similarity(a, b) >= 0.8}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 20


def test_prints_of_near_lines_agree_and_others_do_not():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    texts, n = [], 60
    for _ in range(n):
        line = list(rng.choice(words, 60))
        near = [w if rng.random() > 0.15 else "zz" + w[2:] for w in line]
        texts += [" ".join(line), " ".join(near)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * n)), pa.array(texts)], ["id", "words"])
    out = pa.Table.from_batches(lines._traits(iter([batch.slice(0, 7), batch.slice(7)])))
    bits = np.array([out[f"s{j}"].to_pylist() for j in range(lines.PRINT_WORDS)]).T
    common = np.array([[sum(int(a & b).bit_count() if a & b >= 0 else (int(a & b) + (1 << 64)).bit_count() for a, b in zip(x, y, strict=True)) for y in bits] for x in bits])
    bins = out["bins"].to_numpy()
    assert (np.diag(common) == bins).all() and set(out["text"].to_pylist()) == {None}
    agree = common >= lines.AGREE * np.maximum.outer(bins, bins)
    assert all(agree[i, i + 1] for i in range(0, 2 * n, 2))
    assert (agree.sum() - 4 * n) < 0.02 * agree.size


def test_lines_within_a_number_of_edits():
    rng, texts = random.Random(4), ["", "", "", "abc", "abc", ""]
    for size in [1, 2, 5, 63, 64, 65, 127, 128, 129, 200, 300] * 6:
        one = [rng.choice("abcdefg é世界") for _ in range(size)]
        other = list(one)
        for _ in range(rng.randint(0, max(1, size // 3))):
            i = rng.randrange(len(other) + 1)
            other[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "你"])
        texts += ["".join(one), "".join(other)]
    x = np.arange(0, len(texts), 2)
    distance = np.array([round((1 - edit_similarity(a, b)) * max(len(a), len(b))) if a or b else 0 for a, b in zip(texts[::2], texts[1::2], strict=True)])
    for off in (-1, 0, 2):
        limit = np.maximum(distance + off, 0)
        assert (lines.within(*lines._points(pa.array(texts)), x, x + 1, limit) == (distance <= limit)).all()


def test_lines_that_share_a_passage_make_no_rows_of_pairs(spark, monkeypatch):
    """Half of each line is one passage: every pair's print agrees, hardly any is linked."""
    rng = random.Random(6)
    made = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(n))
    passage = made(28)
    texts = [f"{made(9)} {passage} {made(15)}" for _ in range(80)]
    texts.append(texts[70][:-6] + "xyzxyz")
    tables, old = [], lines.checkpointed

    def seen(df):
        out = old(df)
        if {"a", "b"} <= set(out.columns):
            tables.append(out.count())
        return out

    monkeypatch.setattr(lines, "checkpointed", seen)
    got = [tuple(r) for r in lines.duplicate_lines(docs_of(spark, list(enumerate(texts))), "doc_id", "text").collect()]
    assert got == [(80, 0)] and max(tables) < 500  # of 3240 pairs


def test_operators_leave_one_table(spark, near):
    at = common.written()
    assert lines.dedupe_lines(docs_of(spark, [(1, "one two"), (2, "one two")]), "doc_id", "text").count() == 2
    assert common.written() == at + 1
    kept = corpus_pipeline.near_dedup(spark, docs_of(spark, near), "")
    assert 0 < kept.count() < len(near) and common.written() == at + 2


def test_written_tables_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = spark.range(10_000).repartition(4, "id")
    before = manager.getAllFiles().size()
    written = common.checkpointed(shuffled)
    assert manager.getAllFiles().size() <= before and written.count() == 10_000


class Seen(Exception):
    pass


def test_unrelated_long_lines_meet_in_few_buckets(spark, monkeypatch):
    """Long lines of one language's syllables share many short runs of characters; near ones share far more buckets than these."""
    rng = random.Random(3)
    syllables = "the and ing her hat his tha ere for ent ion ter was you ith ver all wit thi tio".split()
    made = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(made() for _ in range(150))) for i in range(400)]
    near = [(400 + i, text.replace(" the ", " not ")) for i, text in rows[:20]]
    members = []

    def seen(table, *_):
        members.extend(table.collect())
        raise Seen

    monkeypatch.setattr(lines, "bucket_links", seen)
    for part in (rows, rows[:20] + near):
        with pytest.raises(Seen):
            lines.duplicate_lines(docs_of(spark, part), "doc_id", "text")
        members.append(None)
    unrelated, related = members[: members.index(None)], members[members.index(None) + 1 : -1]
    assert len(unrelated) < 100 and len({m.id for m in related}) == 40


def test_lines_of_few_words_go(spark):
    rows = [(1, "and ornd\n\n-----\n***\n"), (2, "And ornd!\n\n ----- \n---\n你好世界今天天气很好我们去公园"), (3, "你好世界今天天气很好我们去公园\n你好世界今天天气真好我们去公园\neding in the\neding im the")]
    got = {tuple(r) for r in lines.duplicate_lines(docs_of(spark, rows), "doc_id", "text").collect()}
    assert got == {(2, 0), (2, 2), (3, 0), (3, 1), (3, 3)}


def test_leaks_reach_recall():
    rng = random.Random(2)
    items = [words(rng, rng.randint(14, 59)) for _ in range(40)]
    it = decontaminate.Items(list(range(40)), [" ".join(x) for x in items], 0.8)
    docs = []
    for x in items:
        y = list(x)
        for _ in range(decontaminate.edits(len(x), 0.8) // 2):
            y[rng.randrange(len(y))] = "other"
        docs.append(" ".join(words(rng, 30) + y + words(rng, 30)))
    found = {(int(a), int(b)) for x in it.search(*decontaminate.word_hashes(pa.array(docs))) for a, b in x[:, :2]}
    assert found == {(i, i) for i in range(40)}


def test_leaks_of_odd_tables(spark):
    item = " ".join(words(random.Random(5), 20))
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    docs = docs_of(spark, [(1, f"x {item} y"), (2, None), (3, "too short"), (None, item), (4, "")])
    got = decontaminate.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(1, 1, 0), (None, 1, 0)}
    assert decontaminate.leaks(docs, "doc_id", "text", items.where("false"), "item_id", "text").count() == 0


def test_spans_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    rows = [(i, rng.choice(base) + rng.choice(base)[rng.randint(0, 200) :]) for i in range(60)] + [(500, None), (None, base[3] * 2), (502, "ab" * 200), (7, base[5])]
    least, data = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 49 if i is not None else 0):
            least[b[p : p + 50]] = min(least.get(b[p : p + 50], i), i)
    want = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), sum(g and not gone[j - 1] if j else g for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffixes.remove_repeats(docs_of(spark, rows), "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (*range(20), 300):
        s = rng.integers(0, 3, n)
        assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_tokens_and_packing(spark):
    texts = ["It's we'll ''s don't'd 12's! x́é İstanbul a\x01b", "", None, "日本語 don't. End.", "word " * 3000, "<|endoftext|> hi"] * 2
    t = WordTokenizer(TOKENS)
    want = [t.library.encode(x or "", add_special_tokens=False).ids for x in texts]
    ids, at = t.ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    rows = packing.pack(docs_of(spark, list(enumerate(texts))).coalesce(1), "doc_id", "text", TOKENS, with_ids=True).collect()
    for i, w in enumerate(want):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == [*w, 1] and {r.doc_tokens for r in mine} == {len(w) + 1}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1]) and sum(n for _, n in parts) <= 2048
    assert packing.pack(docs_of(spark, [(1, "a")]).where("false"), "doc_id", "text", TOKENS).count() == 0


def test_windows_are_optimal():
    rng = random.Random(4)
    for _ in range(30):
        cuts = [0, *sorted(rng.sample(range(1, 40), 15)), 40]
        prices = [0, *[rng.choice([0, 2, 5]) for _ in cuts[1:]]]
        if max(np.diff(cuts)) > 8:
            continue
        best = [0] + [10**9] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            for i in range(j):
                n = cuts[j] - cuts[i]
                if n <= 8:
                    best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else 8 - n) + prices[j])
        ends = packing.windows(cuts, prices, 8)
        cost = sum((0 if (n := cuts[b] - cuts[a]) & (n - 1) == 0 else 8 - n) + prices[b] for a, b in zip([0, *ends[:-1]], ends))
        assert cost == best[-1]


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 17, 1000, 4097):
        f = sharding.Feistel(n, 9)
        x = f.forward(np.arange(n))
        assert sorted(x) == list(range(n)) and (f.inverse(x) == np.arange(n)).all()
    rows = docs_of(spark, [(i % 50, "t") for i in range(101)] + [(None, None)])
    out = sharding.shard(rows, ["doc_id", "text"], 7).collect()
    for s in range(7):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (14, 15)
    assert sharding.shard(rows.where("false"), ["doc_id"], 7).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/x?y"), (2, "http://b.com/fr/#x"), (3, "http://b.com"), (4, None), (5, "nothing"), (6, "x://example.org/en/12"), (7, "http://badexample.org/es/1")]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow")]
    df = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, "url", "bad", ["page_id"], rules).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("b.com", "/fr/", "com/fr/", "allow")
    assert got[3][:3] == ("b.com", "", None) and got[4][:3] == ("", "", None) == got[5][:3]
    assert got[6][2:] == ("example.org/en/1", "block") and got[7][2:] == ("org/", "allow")


def test_bad_hosts_are_blocked(spark):
    df = spark.createDataFrame([("bad.com", 1)] * 40 + [("good.com", 0)] * 40 + [("new.com", None), (None, 1)], "host string, bad int")
    got = {r.host: r.blocked for r in urls.reputation(df).collect()}
    assert got["bad.com"] and not got["good.com"] and len(got) == 4


def test_posterior_tails_equal_counted_ones():
    rng = np.random.default_rng(3)
    for a, b, x in ((2, 8, 0.3), (0.3, 0.9, 0.22), (300, 900, 0.26), (1, 1, 0.25), (0.5, 200, 0.001)):
        want = (rng.beta(a, b, 400_000) > x).mean()
        assert abs(urls.beta_above(np.array([float(a)]), np.array([float(b)]), np.array([x]))[0] - want) < 0.004


def test_quoted_attributes_and_names_that_hold_a_word():
    page = "<article><p title='a > b'>ok</p><p class='share-price'>Share prices rose.</p><div class='related-work'>more</div><div class='comments'>no</div><p>it's <b title=\"x>y\">bold</b></p></article><div class='ad'>x</div>"
    assert [t for _, t in pages.blocks(page)] == ["ok", "Share prices rose.", "more", "it's bold"]


def test_a_document_may_have_many_languages():
    alphabet = ["abcd", "efgh", "ijkl", "mnop", "qrst"]
    rng, cells = random.Random(5), np.full((language.CELLS, 5), 1e-3)
    text = [" ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(300)) for a in alphabet]
    for j, t in enumerate(text):
        np.add.at(cells[:, j], language._trigrams(pa.array([t]))[0], 1)
    model = language.LanguageModel(tuple("abcde"), np.log(cells / cells.sum(0)).astype(np.float32))
    mix, _ = language.infer(model, pa.array([" ".join(text[:4]), text[4]]))
    assert (mix[0] > 0.15).sum() == 4 and mix[1].argmax() == 4 and mix[1].max() > 0.99


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><header>Site</header><nav><a>x</a></nav><article><h1>A &amp; B</h1><p>one<br>two<p>three <b>four</b></article><aside>side</aside><div class='comments'>c</div><footer>f</footer>"
    foot = "<div>all rights of this site are kept by us</div>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", f"<div><p>my own words here</p></div>{foot}"), (3, "http://h/3", f"<div><p>quite different things again</p></div>{foot}"), (4, None, None), (5, "http://h/5", ""), (6, "http://g/", f"<p>x</p>{foot}")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html").collect()}
    assert got == {1: "A & B\none two\nthree four", 2: "my own words here", 3: "quite different things again", 4: "", 5: "", 6: "x\nall rights of this site are kept by us"}


def test_text_after_a_script_stays():
    for script in ("for(i=0;i<n;i++){f(i)}", "if(a<b||c<d)document.write('<p>x<b')", "x<!--y"):
        assert pages.blocks(f"<p>one</p><script>{script}</script><p>two</p><SCRIPT src=a>{script}</Script ><p>three")[-2:] == [(pages.OPEN, "two"), (pages.OPEN, "three")]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = [rng.standard_normal(8).astype(np.float32).tolist() for _ in range(150)] + [[1.0] * 8] * 40
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(900, None, 1), (1000, [0.0] * 8, 1), (1001, [float("nan")] * 8, 1), (1002, [None] + [1.0] * 7, 1)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, v array<float>, leaf int"), "vec_id", "v", "vec_id % 10 = 0").collect()
    x = np.array(v, float)
    for q in range(0, 190, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(190), d)) if i != q][:10]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_language_held_out(spark):
    rng, rows = random.Random(6), []
    parts = {"en": ["the", "ing", "and", "ou"], "de": ["sch", "ein", "ung", "ü"], "fr": ["eau", "é", "oi", "que"]}
    for i in range(240):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30)), lang))
    rows += [(900, None, "en"), (901, "123 !", "en"), (902, "the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where(~language.held_out("doc_id")), "doc_id", "text", "lang")
    got = language.identify(df, "text", model, ["doc_id", "lang"]).withColumn("held", language.held_out("doc_id")).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901)} == {900: "und", 901: "und"}
    assert all(r.lang == r.lang_pred for r in got if r.held and r.doc_id < 900) and all(0 <= r.score <= 1 for r in got)
    empty = language.fit(df.where("false"), "doc_id", "text", "lang")
    assert language.identify(df, "text", empty, ["doc_id"]).where(F.col("lang_pred") != "und").count() == 0
