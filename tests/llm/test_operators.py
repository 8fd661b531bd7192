"""Each operator against brute force on a small fixture, and on nulls, empty texts, ties, repeated rows, an empty table and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomwright.llm import bpe, chat, decontaminate, fingerprints, language, native, near_duplicates, quality, secrets, token_counts  # noqa: E402
from loomwright.llm.common import held_out, texts, unpacked, unpacked_sorted  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, n_tokens string, score string, sketch string"
WORDS = [a + b + c for a in ("th", "er", "on", "st", "re") for b in ("a", "e", "ou", "i") for c in ("nd", "r", "sh", "")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    texts = [prose(i, 60 + 7 * i) for i in range(40)]
    texts += [texts[3], texts[3], texts[5] + " more words", texts[6][:-9], None, "", "   \n\t", "a", "two words", "!!! ???", "É" * 300, "x" * 5000, prose(99, 9000), texts[7] + "\n" + prose(77, 20) + " end"]
    return [(i, t, "en" if i % 3 else "fr", "src", len(t or ""), "c", "n", "s", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_containment(spark, docs, empty):
    items = spark.createDataFrame([(1, prose(77, 20)), (2, prose(1, 67)[10:130]), (3, None), (4, ""), (5, "two words"), (6, prose(5, 12))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.find_contained(docs, items).collect()}
    want = {}
    for i, t, *_ in rows():
        for k, s in ((r.item_id, shingle_set(r.text)) for r in items.collect()):
            if s and len(s & shingle_set(t)) / len(s) >= 0.8:
                want[i, k] = len(s & shingle_set(t)) / len(s)
    assert got == pytest.approx(want) and any(k == 1 for _, k in want)
    kept = {r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()}
    assert kept == {r[0] for r in rows()} - {i for i, _ in want}
    assert decontaminate.find_contained(empty, items).count() == 0 and decontaminate.without_contaminated(docs, items.limit(0)).count() == docs.count()


def test_short_items_inside_long_documents(spark):
    base = [prose(6000 + i, 40 + 60 * i) for i in range(12)]
    parts = [" ".join(f"u{k}x{j}" for j in range(n)) for k, n in enumerate([5, 5, 5, 6, 6, 6, 7, 7, 8, 9, 10, 12] * 4)]
    parts += [" ".join(b.split()[9 : 9 + n]) for b in base for n in (5, 6)]
    items = list(enumerate([*parts, "one", "two words", "!"]))
    texts = [" ".join([b[: len(b) // 2], *(p for k, p in enumerate(parts[:48]) if (i * k + k // 5) % 4 < 2), b[len(b) // 2 :]]) for i, b in enumerate(base)]
    # near items: one word of the end changed, so that 4 of 5 shingles and more are there
    texts += [f"{prose(7000 + k, 300)} {p.rsplit(' ', 1)[0]} {prose(7100 + k, 200)}" for k, p in enumerate(parts[:48])] + ["Two, words", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.shared for r in decontaminate.find_contained(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    sets = [shingle_set(t) for t in texts]
    want = {(i, k): len(s & own) for k, t in items if (own := shingle_set(t)) for i, s in enumerate(sets) if len(s & own) / len(own) >= 0.8}
    assert got == want and len(want) > 200 and any(k < 48 and v < len(shingle_set(items[k][1])) for (_, k), v in want.items())


def test_fingerprints(docs, empty):
    got = {r.doc_id: r for r in fingerprints.compare_with_edited(docs).withColumns({"near": fingerprints.likeness("sketch", "edited"), "nxt": fingerprints.likeness("sketch", "next_sketch")}).collect()}
    own = {r[0]: r[1] or "" for r in rows()}
    ids, sketch_of = sorted(own, reverse=True), {}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(own[a]) // 2
        edited = own[a][: len(own[a]) - half] + own[b][:half]
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[a].n_chars == len(own[a])
        assert got[a].next_sketch == got[b].sketch and sketch_of.setdefault(own[a], got[a].sketch) == got[a].sketch
        assert 0 <= got[a].near <= 1 and 0 <= got[a].nxt <= 1
        want = shingle_set(own[a])
        if len(want) > 400:
            assert abs(len(got[a].sketch) / len(want) - 1 / fingerprints.SCALE) < 0.08
    assert fingerprints.compare_with_edited(empty).count() == 0


def plain_sketch(hashes):
    """The sketch of a set of hashes, by sets alone."""
    low = sorted(h for h in set(hashes) if h < (1 << 63) // fingerprints.SCALE)
    return low or sorted(set(hashes))[:1]


def test_sketches_by_sets(spark, docs):
    every = native.shingled(texts(docs), "text", "hashes").select("doc_id", "text", "hashes")
    every = fingerprints.sketched(every, "text", "sketch").collect()
    assert all(r.sketch == plain_sketch(r.hashes) and len(set(r.hashes)) == len(shingle_set(r.text)) for r in every)
    of = {r.doc_id: r for r in every}
    pairs = spark.createDataFrame([(a, b, of[a].sketch, of[b].sketch) for a in (0, 3, 39, 46, 48, 49) for b in (1, 3, 40, 46, 49, 52)], "a long, b long, x array<bigint>, y array<bigint>")
    for r in pairs.select("a", "b", "x", "y", fingerprints.merged("x", "y").alias("both"), fingerprints.likeness("x", "y").alias("near"), fingerprints.containment("x", "y").alias("within")).collect():
        x, y = set(r.x), set(r.y)
        assert r.both == plain_sketch(of[r.a].hashes + of[r.b].hashes)
        assert r.near == (len(x & y) / len(x | y) if x | y else 1) and r.within == (len(x & y) / len(x) if x else 1)
    groups = spark.createDataFrame([(r.doc_id % 5 or None, r.sketch) for r in every], "g long, sketch array<bigint>")
    got = {r.g: r.sketch for r in fingerprints.merge_sketches(groups, ["g"]).collect()}
    assert got == {g: plain_sketch([h for r in every if (r.doc_id % 5 or None) == g for h in r.hashes]) for g in (None, 1, 2, 3, 4)}


def test_any_ids_have_a_next_document(spark):
    rng = random.Random(4)
    ids = [0, 2**62, -(2**62) - 5, 2**63 - 1, -(2**63), None, 7, 7, *(rng.randrange(50_000) for _ in range(2000)), *([9] * 500)]
    table = spark.createDataFrame([(x, f"t{i % 1700}") for i, x in enumerate(ids)], "doc_id long, text string").repartition(6)
    got = fingerprints.with_next(table, lambda df: df, ["text"], together=50).collect()
    order = sorted(((x, f"t{i % 1700}") for i, x in enumerate(ids)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == Counter((x, t, n) for (x, t), (_, n) in zip(order, order[1:] + order[:1]))
    assert fingerprints.compare_with_edited(spark.createDataFrame([(0, "a b"), (2**62, "c")], "doc_id long, text string")).count() == 2


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "a\\<|end|>\n", "<|turn|>user\nx<|end|>\n", "", None, "é<s>😀", "[/INST", "x" * 9000]
    turns = [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "system", "to\nol\\", None]), odd[(c + t) % len(odd)]) for c in range(6) for t in range(7)]
    df = spark.createDataFrame(turns + [(None, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in range(6):
        own = [(r or "", t or "") for k, _, r, t in sorted(turns, key=lambda x: x[:2]) if k == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[None].n_turns == 1 and chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    for r in chat.format_conversations(df).collect():
        inside = [chat.unescaped(t) for _, t in chat.parse(r.formatted)]
        assert len(inside) == r.n_turns
        for _, body in chat._TURN.findall(r.formatted):
            assert not any(c in body for c in chat.CONTROL)


def test_long_and_hot_conversations(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"{k} é </s> " * 30_000) for k in range(30)] + [(2, 0, "user", "x" * 6_000_000), (2, 1, "assistant", "ok"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*t, "c", True) for t in turns], "conv_id long, turn long, role string, text string, segment string, last boolean")
    segments = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for c in (1, 2, 3):
        own = [(r, t) for k, _, r, t in turns if k == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
    rows = segments.select("conv_id", "segment", "last").collect()
    for c in (1, 2, 3):
        own = [(r.segment, r.last) for r in rows if r.conv_id == c]
        assert own == [(k, k == len(own) - 1) for k in range(len(own))] and (c != 1 or len(own) > 2)


def test_quality(spark, docs, empty):
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(i, 50).split())) for i in range(60)] + [(200 + i, prose(500 + i, 50)) for i in range(60)]
    table = spark.createDataFrame(bad, "doc_id long, text string")
    labels = table.select("doc_id", (F.col("doc_id") >= 200).cast("int").alias("quality"))
    out = held_out("doc_id", 3, 1)
    net = quality.fit(table, labels, ~out)
    got = quality.score(table, net).join(labels, "doc_id").where(out)
    assert got.where("predicted = quality").count() >= 0.9 * got.count()
    scores = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert len(scores) == len(rows()) and all(0 <= s <= 1 for s in scores.values()) and scores[3] == scores[40]
    assert quality.score(empty, net).count() == 0 and quality.keep_good(docs, net).columns == docs.columns
    assert quality.score(docs, quality.fit(empty, labels.limit(0))).where("score = 1").count() == len(rows())
    long = pa.array([prose(1, 4000), prose(1, 4000) + " " + "AB!! " * 300])
    a, b = net.scores(long)
    assert a > b  # what comes last counts too
    # labelled texts that are all long are fitted to, by chunks at even distances
    far = table.withColumn("text", F.concat(F.lit(" " * 20_000), F.repeat("text", 60)))
    spread = quality.score(far, quality.fit(far, labels, ~out)).join(labels, "doc_id").where(out)
    assert spread.where("predicted = quality").count() >= 0.9 * spread.count()


def plain_channels(net, text):
    """The network's pooled channels by loops over positions."""
    data, step, rows = text.encode(), quality.CHUNK - quality.OVERLAP, []
    for begin in range(0, max(1, len(data) - quality.OVERLAP), step) if data else ():
        line = np.frombuffer(data[begin : begin + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8)
        x = net.embed[line]
        best = [max(0.0, max(float((x[k : k + quality.WIDTH].ravel() * net.filters[:, f]).sum()) + net.bias[f] for k in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE))) for f in range(quality.FILTERS)]
        share = max((line[k - lag] == line[k]) & (line[k] > 0) if quality.SPAN == 1 else sum(bool(line[i] == line[i - lag] and line[i]) for i in range(k, k + quality.SPAN)) / quality.SPAN for lag in quality.LAGS for k in range(lag, quality.CHUNK - quality.SPAN + 1))
        rows.append([*best, share])
    if not rows:
        return np.zeros(2 * (quality.FILTERS + 1))
    return np.concatenate([np.max(rows, axis=0), np.mean(rows, axis=0)])


def test_quality_network_is_a_convolution():
    net = quality.Network(3)
    net.bias[:] = np.linspace(-0.2, 0.2, quality.FILTERS)
    texts = [prose(4, 30), prose(5, 250), "", "ab" * 90]
    want = [1 / (1 + np.exp(-(plain_channels(net, t) @ net.out + net.base[0]))) for t in texts]
    assert net.scores(pa.array(texts)) == pytest.approx(want, rel=1e-4)


def test_quality_gradients_are_those_of_the_loss():
    net, label = quality.Network(5), np.array([1.0, 0.0], np.float32)
    body, offsets = quality.flat(pa.array([prose(6, 260), prose(7, 80)]))
    begin, end, own = quality.chunks_of(offsets)
    lines = quality.windows(body, begin, end)
    periodic = quality.repeats(lines)
    params = [net.embed, net.filters, net.bias, net.out, net.base]

    def loss():
        c = np.concatenate([net.convolved(lines)[0], periodic[:, None]], axis=1).astype(np.float64)
        f = np.array([np.concatenate([c[own == i].max(axis=0), c[own == i].mean(axis=0)]) for i in range(2)])
        p = 1 / (1 + np.exp(-(f @ net.out + net.base)))
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean() + 5e-5 * (net.out**2).sum()

    got = net.gradients(lines, periodic, own, label)
    for q, g in zip(params, got):
        # along the gradient, a step of which changes the loss by its length
        if np.abs(g).max() > 1e-6:
            way = g / np.sqrt((g**2).sum())
            saved, e = q.copy(), 2e-4
            q[...] = saved + e * way
            up = loss()
            q[...] = saved - e * way
            down = loss()
            q[...] = saved
            assert (up - down) / (2 * e) == pytest.approx(float(np.sqrt((g.astype(np.float64) ** 2).sum())), rel=0.05)


def test_near_duplicates(spark, docs, empty):
    base = [prose(1000 + i, 300) for i in range(8)]
    near = [" ".join(["odd" if k == 7 * j else w for k, w in enumerate(b.split())]) for b in base for j in range(4)]
    table = spark.createDataFrame(list(enumerate(base * 3 + near + [prose(2000 + i, 200) for i in range(10)])) + [(None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(table).collect()}
    texts = base * 3 + near
    for i, t in enumerate(texts):
        for j in range(i):
            a, b = shingle_set(t), shingle_set(texts[j])
            if len(a & b) / len(a | b) >= 0.85:
                assert got[i] == got[j]
    assert len(got) == len(texts) + 10 and len(set(got.values())) == 18
    few = {r.doc_id: (r.class_id, r.text_id) for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert few[40] == few[41] == (3, 3) and few[44] == few[45] and few[46][0] != few[44][0] and len(few) == len(rows())
    assert near_duplicates.near_duplicate_classes(empty).count() == 0


def test_no_link_of_a_bucket_is_lost(spark):
    rng, texts = random.Random(7), []
    for family in range(3):
        line = prose(5000 + family, 120).split()
        for k in range(25):  # a chain: each text is near some of its neighbours only
            line[rng.randrange(120)] = f"w{family}x{k}"
            texts.append(" ".join(line))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near_duplicates.text_sets(table, table.select("doc_id"), len(texts), 0.8)
    read = {r.doc_id: (unpacked_sorted(r.set, r.n), unpacked(r.set, np.float32, r.n, 8 * r.n)) for r in sets.collect()}
    want = {(a, b) for a in read for b in read if a > b and near_duplicates.similarity(read[a], read[b]) >= 0.8}
    bucket = sets.select("doc_id", F.lit(1).alias("key"))
    nothing = spark.createDataFrame([], "doc_id long, root long")
    pairs = near_duplicates.across_components(bucket, nothing, sets, 0.8)
    assert {(r.a, r.b) for r in near_duplicates.verified(pairs, sets, 0.8).collect()} == want and 30 < len(want) < len(read) ** 2 / 4
    classes = spark.createDataFrame([(i, i // 25) for i in read], "doc_id long, root long")
    assert all(r.a // 25 != r.b // 25 for r in near_duplicates.across_components(bucket, classes, sets, 0.8).collect())


def test_consistent_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    w = rng.uniform(0.5, 1, 300).astype(np.float32)
    a, b = (h[:250], w[:250]), (h[30:], w[30:])
    both = near_duplicates.consistent_samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 250]), 2000)
    want = w[30:250].sum() / w.sum()
    assert abs((both[0] == both[1]).mean() - want) < 0.04 and near_duplicates.similarity(a, b) == pytest.approx(want, rel=1e-5)


def test_bpe(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    own = {r[0]: r[1] or "" for r in rows()} | {}
    got = {r.doc_id: r for r in bpe.encode_digests(docs, path).collect()}
    for i, t in own.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rng, model = random.Random(5), bpe.load(path)
    odd = ["".join(rng.choice("ab <|endoftext|>'s é\n\t中😀 1") for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["<|endoftext|>x<|endoftext|>", "z" * 300]
    ids, n = model.encode(odd)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in lib.encode_batch(odd, add_special_tokens=False)]
    # long words: proposals that begin afresh, and exact merging of what fails
    alphabet = "abcdefghij"
    long = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (200, 257, 512, 700, 3000)] + ["the" * 400, "a" * 1000, "中" * 500, "=" * 4000, " " * 900]
    ids, n = model.encode(long)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in lib.encode_batch(long, add_special_tokens=False)]
    with pytest.raises(ValueError, match="not built"):
        bpe.Model(public_tokenizers.path("word_bpe_49k.json"))
    assert bpe.encode_digests(empty, path).count() == 0 and {r.doc_id: r.decoded for r in bpe.encode_documents(docs, path).collect()} == own


def test_token_counts(spark, docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    for i, t, *_ in rows():
        n = len(lib.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    odd = ["▁a▁▁b", "<s>hi</s>", " lead", "trail  ", "a\n\n b", "\n", "é中😀", "z" * 200_000, None]
    table = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(odd)], "doc_id long, text string").coalesce(1)
    found = token_counts.token_counts(table, path).collect()
    assert [r.n_tokens for r in found] == [len(x) for x in lib.encode([t or "" for t in odd])] and [r.doc_id for r in found] == [None if i % 2 else 7 for i in range(9)]
    assert token_counts.token_counts(empty, path).count() == 0


def test_each_pretoken_is_counted_once(docs, monkeypatch):
    path, seen = public_tokenizers.path("piece_bpe_32k.model"), docs.sparkSession.sparkContext.accumulator(0)
    own = token_counts.count_pieces
    monkeypatch.setattr(token_counts, "count_pieces", lambda words, path: (seen.add(len(words)), own(words, path))[1])
    token_counts.token_counts(docs, path).collect()
    assert seen.value == len({w for r in rows() for w in token_counts.pretokens(r[1] or "")})


def test_language(spark, empty, docs):
    table = spark.createDataFrame([(i, " ".join(random.Random(i).choices(["the", "house", "walked", "ring"] if i % 2 else ["le", "maison", "était", "école"], k=12)), "en" if i % 2 else "fr") for i in range(80)], "doc_id long, text string, lang string")
    model = language.fit(table, ~held_out("doc_id", 4, 2))
    got = language.identify(table, model).join(table, "doc_id")
    assert got.where("lang = lang_pred").count() == 80
    new = spark.createDataFrame([(1, "écolier"), (2, None), (3, "123 !"), (4, ""), (5, "walking")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(new, model).collect()} == {1: "fr", 2: "und", 3: "und", 4: "und", 5: "en"}
    assert language.identify(empty, model).count() == 0 and language.identify(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0


def plain_language(counts, text):
    """Scores of a text by the words-first rule, with dictionaries of words and of n-grams."""
    langs = sorted(counts)
    total = sum(c.total() for c in counts.values())
    every = set().union(*counts.values())
    logs = lambda table, key, size: np.log([(table[k][key] + 0.5) / (table[k].total() + 0.5 * (size + 1)) for k in langs])
    levels = {}
    for n in range(1, language.LONGEST + 1):
        cut = lambda w, n=n: [m[i : i + n] for m in [f"<{w}>" if n > 1 else w] for i in range(len(m) - n + 1)]
        levels[n] = cut, {k: Counter(g for w, c in counts[k].items() for g in cut(w) for _ in range(c)) for k in langs}
    score = np.log([(counts[k].total() + 1) / (total + len(langs)) for k in langs])
    for w in language._WORD.findall(text.lower()):
        if w in every:
            score = score + logs(counts, w, len(every))
            continue
        for n in range(language.LONGEST, 0, -1):
            cut, table = levels[n]
            known = set().union(*table.values())
            if own := [g for g in cut(w) if g in known]:
                score = score + np.mean([logs(table, g, len(known)) for g in own], axis=0)
                break
    p = np.exp(score - score.max())
    return langs[int(p.argmax())], p.max() / p.sum()


def test_language_by_dictionaries():
    counts = {"en": Counter("the house the ring walked once".split()), "fr": Counter("le maison était une école le le".split()), "de": Counter("der hund lief".split())}
    model, rng = language.Model(counts), random.Random(2)
    words = [*(w for c in counts.values() for w in c), "walking", "écolier", "hunde", "zzz", "ça", "日本", "once"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(80)]
    lang, score = model.predict(texts)
    want = [plain_language(counts, t) for t in texts]
    assert lang == [w[0] for w in want] and score == pytest.approx([w[1] for w in want], rel=1e-3)
    assert model.predict(["½ ²", "Ⅷ", "12 !", "", None]) == (["und"] * 5, [0.0] * 5)


def test_secrets(spark, docs, empty):
    model = secrets.fit(secrets.labelled_findings(spark, 1500))
    key, hexed = "AKIA" + "QZ7K2M9PLX4T8WVB", "0ab3f9c2d4e8b7a6c5d4e3f2a1b0c9d8e7f6a5b4"
    texts = [f"é first {key} then {key} end", f'set token = "{hexed}" now', "password=your_password_here", "mail a@b.example.com 4041894974608795", None, "", f"commit {hexed} merged"]
    table = spark.createDataFrame([(i, t, "src", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, start int")
    found = secrets.find_secrets(table, model)
    assert {(r.doc_id, r.candidate) for r in found.collect()} == {(0, key), (1, hexed)} and found.count() == 3
    for r in found.collect():
        assert texts[r.doc_id][r.start : r.start + r.length] == r.candidate
    clean = {r.doc_id: r.text for r in secrets.redact(table, found).collect()}
    assert clean == {0: "é first [SECRET] then [SECRET] end", 1: 'set token = "[SECRET]" now'} | {i: t for i, t in enumerate(texts) if i > 1}
    assert secrets.find_secrets(empty, model).count() == 0 and secrets.find_secrets(docs, model).count() == 0


def test_secrets_go_by_the_row(spark):
    model, key = secrets.fit(secrets.labelled_findings(spark, 1500)), "AKIA" + "QZ7K2M9PLX4T8WVB"
    plain = "no secret in this one, but as long as the others are"
    texts = [(None, f"first {key} of all"), (5, f"and then {key} end"), (5, plain), (5, plain), (None, None), (6, f"{key} {key}"), (6, f"{key} {key}")]
    table = spark.createDataFrame([(i, t, "src", "x", 1) for i, t in texts], "doc_id long, text string, source string, __spans string, h1 int").repartition(4)
    clean = secrets.redact(table, secrets.find_secrets(table, model))
    assert clean.columns == table.columns
    want = [(i, t and t.replace(key, "[SECRET]")) for i, t in texts]
    assert sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(map(str, want))
    assert secrets.redact(table.limit(0), secrets.find_secrets(table.limit(0), model)).count() == 0


def plain_features(candidate, left, right, path):
    """The features that can be said in a few words, by Python's own means."""
    n, near = max(len(candidate), 1), f"{left} {right}"
    kind = lambda c: "d" if c.isdigit() else "a" if c.isalpha() else "o"
    pairs = secrets.letter_pairs()
    return {
        "length": len(candidate), "digits": sum(c in "0123456789" for c in candidate) / n, "uppers": sum("A" <= c <= "Z" for c in candidate) / n,
        "distinct": len(set(candidate)) / n, "likely": sum(pairs.get(candidate[i : i + 2].lower(), pairs[""]) for i in range(len(candidate) - 1)[:256]) / max(1, min(256, len(candidate) - 1)),
        "dictionary": 1 - len(re.sub(secrets.DICTIONARY, "", candidate.lower())) / n, "hex": float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", candidate))),
        "near_hash": float(bool(re.search(r"(?i)\b(?:sha-?\d*|md5|commit|checksum|digest|uuid|etag|integrity)\b", near))), "trusted_path": float(bool(re.search(secrets.TRUSTED_PATH, path, re.I))), "classes": len(set(map(kind, candidate))),
    }


def test_features_and_candidates_by_plain_means(spark):
    found = secrets.labelled_findings(spark, 400)
    for r in secrets.described(found).collect():
        want = plain_features(r.candidate, r.left_context, r.right_context, r.path)
        want.pop("classes")
        assert {k: r[k] for k in want} == pytest.approx(want)
    rng, parts = random.Random(3), ["token = ", "password:", "AKIA" + "Q7" * 8, "ghp_" + "a1B2" * 9, "plain words", "0123456789abcdef" * 2, "\n", "x" * 30, "é", " ", "'", '"', "xoxb-1234567890ab", "a/b/c_d-e1" * 3]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(60)]
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    value = re.compile(rf"(?i:{secrets.NAMES})[\"']?\s?[:=]{{1,2}}\s?[\"']?({secrets.VALUE})", re.A)
    want = []
    for i, t in enumerate(texts):
        for m in re.finditer(secrets.PATTERN, t, re.A):
            own = None if re.fullmatch(secrets.FORMATS, m[0], re.A) else value.fullmatch(m[0])
            want.append((i, m.start() + (own.start(1) if own else 0), own[1] if own else m[0]))
    assert sorted((r.doc_id, r.start, r.candidate) for r in secrets.candidates(table).collect()) == sorted(want) and len(want) > 100


def test_long_secrets_are_found_whole(spark):
    model, rng = secrets.fit(secrets.labelled_findings(spark, 1500)), random.Random(11)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    run = lambda n, of=b64: "".join(rng.choice(of) for _ in range(n))
    values = [run(n, of) for n in (199, 201, 300, 320, 2000, 20000) for of in (b64, "0123456789abcdef")]
    values += ["eyJ" + ".".join(run(k) for k in n) for n in ((30, 200, 43), (60, 300, 86), (30, 2000, 342))]
    texts = [f'{name}{v}{end} and more' for v in values for name, end in (('token = "', '"'), ("token: ", ""), ("set api_key='", "'"))]
    table = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.candidate) for r in secrets.candidates(table).collect()} == {(i, values[i // 3]) for i in range(len(texts))}
    found = secrets.find_secrets(table, model)
    assert {(r.doc_id, r.candidate) for r in found.collect()} == {(i, values[i // 3]) for i in range(len(texts))}
    assert {r.doc_id: r.text for r in secrets.redact(table, found).collect()} == {i: t.replace(values[i // 3], "[SECRET]") for i, t in enumerate(texts)}


def test_letter_pairs_of_all_of_a_long_value(spark):
    rng, pairs = random.Random(12), secrets.letter_pairs()
    noise, said = "".join(rng.choice("QXZJqxzj0123456789") for _ in range(257)), "password" * 40
    values = ["", "a", "é😀B2", noise[:256], noise, noise + "e", noise + said, noise + noise[::-1], said + noise, said + said, noise + "İÉ😀_" + said, noise * 40 + said * 40]
    rows = spark.createDataFrame([(i, v, "", "", "") for i, v in enumerate(values)], "doc_id int, candidate string, left_context string, right_context string, path string")
    got = {r.doc_id: r.likely for r in secrets.described(rows).collect()}
    plain = lambda v: [pairs.get("".join(map(str.lower, v[i : i + 2])), pairs[""]) for i in range(max(1, len(v) - 1))]
    assert got == pytest.approx({i: sum(plain(v)) / len(plain(v)) for i, v in enumerate(values)}, rel=1e-9)
    assert got[6] > got[7] + 0.5 and got[8] < got[9] - 0.5  # equal beginnings, other ends


def test_keys_without_a_digit_are_searched(spark):
    keys = [head + "QZBKLMNOPTUVWXYC" for head in ("AKIA", "ASIA")]
    table = spark.createDataFrame([(i, f"the {k} and more", "src") for i, k in enumerate(keys)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.candidate) for r in secrets.candidates(table).collect()} == set(enumerate(keys))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = [prose(3000 + i, 120) for i in range(60)]
    key = "AKIA" + "QZ7K2M9PLX4T8WVB"
    texts = base + [base[0], base[1] + " tail", " ".join(w.upper() + "!!" for w in base[2].split()), prose(1, 50) + " " + prose(42, 30), base[3][:200] + f" {key} " + prose(8, 60)]
    texts += [" ".join(w.upper() + "!!" for w in prose(4000 + i, 60).split()) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("!!" not in t), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(42, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(60), 64} and key not in got[64].decoded and "[SECRET]" in got[64].decoded and got[5].decoded == base[5]


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    base, key = [prose(8000 + i, 120) for i in range(8)], "AKIA" + "QZ7K2M9PLX4T8WVB"
    rows = [(0, base[0]), (0, base[0]), (7, base[0]), (7, base[1]), (None, base[2]), (None, base[2]), (None, f"{base[3]} {key}"), (9, f"{base[3]} {key}"), (11, base[4] + " " + prose(42, 30)), (None, base[5] + " " + prose(42, 30)), (12, None), (13, ""), (14, base[6] + " " + prose(12, 9000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __gone string, key string")
    spark.createDataFrame([(0, prose(42, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
    got = [(r.doc_id, r.text) for r in out.collect()]
    want = [(0, base[0]), (7, base[1]), (None, base[2]), (9, f"{base[3]} [SECRET]"), (12, None), (14, rows[-1][1])]
    assert sum(not t for _, t in got) == 1  # null and empty texts are copies of each other
    assert sorted(map(str, (r for r in got if r[1]))) == sorted(map(str, (r for r in want if r[1])))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_group_that_holds_a_third_of_all_rows(spark):
    rng, base, texts = random.Random(21), prose(9500, 200).split(), []
    for k in range(60):  # copies of one text with a word or two changed: similarity to it 0.9 and more
        own = list(base)
        for at in rng.sample(range(200), 2):
            own[at] = f"e{k}x{at}"
        texts.append(" ".join(own))
    texts += [" ".join(random.Random(9600 + k).choice(WORDS) + str(k) for _ in range(200)) for k in range(120)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(table).collect()}
    assert {got[k] for k in range(60)} == {0} and all(got[k] == k for k in range(60, 180))


def test_copies_are_compared_with_what_they_are_copies_of(spark, monkeypatch):
    rng, base = random.Random(22), prose(9700, 200).split()
    texts = []
    for k in range(80):  # each 0.8 and more to the text, and below 0.8 to most others
        own = list(base)
        for at in rng.sample(range(200), 3):
            own[at] = f"f{k}x{at}"
        texts.append(" ".join(own))
    texts.append(" ".join(base))  # the last id of all
    compared = []
    own = near_duplicates.verified
    monkeypatch.setattr(near_duplicates, "verified", lambda pairs, *a: (compared.append(pairs.count()), own(pairs, *a))[1])
    got = near_duplicates.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(compared) < 400
