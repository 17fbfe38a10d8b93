"""Corpus operators against brute force, exact round trips, and odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, importance, licenses, quality_rules, sentencepiece_codec, shingle_join, simhash, suffix_dedup, token_counts, token_files
from spanloom.llm.components import connected_components
from spanloom.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, pool=40):
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def corpus(seed=1):
    r = random.Random(seed)
    base = [words(r, r.randint(5, 120), 400) for _ in range(25)]
    passage = words(r, 90, 10_000)
    texts = base + base[:5] + [b + " extra" for b in base[:8]] + [b[: len(b) // 2] + passage + b[len(b) // 2 :] for b in base[5:9]]
    texts += ["", None, "a", "a b", "é " * 300, "x" * 3000, words(r, 4000, 100_000), "  \n\t ", "<|endoftext|> hi  there"]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, docs, empty):
    fp = {i: brute_simhash(t) for i, t, *_ in corpus()}
    want = roots_of(fp, [(a, b) for a in fp for b in fp if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = simhash.near_duplicate_components(docs).collect()
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == fp
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert simhash.near_duplicate_components(empty).count() == 0


def test_covering_links_in_crowded_buckets(spark):
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centre for _ in range(60)})
    signed = [simhash._signed(x) for x in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    got = {x["node"]: x["root"] for x in connected_components(simhash.covering_links(nodes, 2)).collect()}
    want = roots_of(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {n: got.get(n, n) for n in range(len(fps))} == want


def test_covering_masks_let_every_pair_within_the_radius_meet():
    masks, r = simhash.covering_masks(list(range(64)), 6), random.Random(2)
    for _ in range(500):
        diff = sum(1 << b for b in r.sample(range(64), 6))
        assert any(not m & diff for m in masks)


def test_covering_masks_keep_many_places():
    for places, radius in [(64, 6), (64, 2), (40, 6), (28, 2)]:
        masks = simhash.covering_masks(list(range(places)), radius)
        # all pairs of places: a difference of two bits is masked out by some table
        assert all(any(not m & (1 << a | 1 << b) for m in masks) for a in range(places) for b in range(a))
        assert min(m.bit_count() for m in masks) >= places // 5


def test_near_copies_keep_one_of_each_group(spark):
    r = random.Random(3)
    base = [words(r, 200, 5000).split() for _ in range(6)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:3]):
        c = list(b)
        c[100] = "changed"
        rows += [(10 + i, " ".join(c)), (20 + i, " ".join(b))]
    got = shingle_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in got.collect()) == [0, 1, 2, 3, 4, 5]


def test_near_copies_equal_brute_force_jaccard(spark):
    r = random.Random(21)
    texts = []
    for i in range(40):
        b = words(r, r.randint(60, 300), 20_000).split()
        texts.append(b)
        for _ in range(4):
            # replaced words and added passages, so that similarities lie on both sides of 0.8
            c, n = list(b), len(b)
            for at in r.sample(range(n), r.randint(0, max(1, n // 35))):
                c[at] = "changed"
            at = r.randrange(n)
            texts.append(c[:at] + words(r, r.randint(0, n // 4), 20_000).split() + c[at:])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    j = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}
    assert sum(0.75 <= x < 0.8 for x in j.values()) > 10 and sum(0.8 <= x < 0.85 for x in j.values()) > 10
    want = roots_of(range(len(texts)), [p for p, x in j.items() if x >= 0.8])
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in shingle_join.similar_components(d).collect()} == want


def test_crowded_buckets_are_compared_whole(spark):
    # a template makes 5 in 6 words of most texts: pairs fall on both sides of 0.8, and some are twins
    r, template = random.Random(22), words(random.Random(23), 100, 5000).split()
    texts = [template[: r.randint(88, 100)] + words(r, r.randint(8, 14), 10**6).split() for _ in range(2500)]
    texts += [t[:-1] + ["twin"] for t in r.sample(texts, 150)]
    # shuffled parts of the template: thousands that share shingles, and are no copies
    parts = [template[i : i + 10] for i in range(0, 100, 10)]
    for _ in range(500):
        r.shuffle(parts)
        texts.append(sum(parts, []) + words(r, 10, 10**6).split())
    r.shuffle(texts)
    ids, rows = {}, np.zeros((len(texts), 125), np.int64) - 1
    for i, t in enumerate(texts):
        s = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
        rows[i, : len(s)] = [ids.setdefault(x, len(ids)) for x in s]
    n, held = (rows >= 0).sum(axis=1), collections.defaultdict(list)
    for i, k in zip(*np.nonzero(rows >= 0)):
        held[rows[i, k]].append(i)
    both = np.zeros((len(texts), len(texts)), np.int16)
    for members in held.values():
        if len(members) > 1:
            both[np.ix_(members, members)] += 1
    near = np.argwhere(np.triu(both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-9, 1)).tolist()
    want = roots_of(range(len(texts)), near)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert len(set(want.values())) > 500 and {x["doc_id"]: x["component_id"] for x in shingle_join.similar_components(d).collect()} == want


def test_a_group_of_copies_makes_pairs_by_its_size(spark, monkeypatch):
    r, size, tried = random.Random(3), 30, []
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(size):
        text = list(base)
        for at in r.sample(range(5, 195), 2):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    plausible = shingle_join.plausible

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return plausible(pairs, *rest)

    monkeypatch.setattr(shingle_join, "plausible", counted)
    got = shingle_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["component_id"] for x in got} == {0} and len(got) == size
    assert sum(tried) <= 3 * size  # all pairs are 435


def test_components_of_few_edges_equal_the_distributed_ones(spark):
    r = random.Random(5)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7), (None, 3), (2**62, -(2**62))]
    e = spark.createDataFrame(edges, "a long, b long")
    want = sorted(connected_components(e).collect())
    few = connected_components(e, few=10_000)
    assert len(want) > 100 and sorted(few.collect()) == want and few.dtypes == [("node", "bigint"), ("root", "bigint")]
    assert connected_components(e.limit(0), few=10).collect() == []


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_equals_brute_force(spark, docs, empty, hot):
    w = 130
    texts = {i: (t or "").encode() for i, t, *_ in corpus()}
    n = collections.Counter(t[a : a + w] for t in texts.values() for a in range(len(t) - w + 1))
    for r in suffix_dedup.remove_repeats(docs, window=w, hot=hot).collect():
        t = texts[r["doc_id"]]
        kept, runs = suffix_dedup._cut(t, [(a, a + w) for a in range(len(t) - w + 1) if n[t[a : a + w]] > 1])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_deep_shallow_sorts():
    r = random.Random(4)
    s = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) * r.randint(1, 12) for _ in range(200)]
    order, lcp = suffix_dedup.deep_shallow(s, np.zeros(len(s), np.int64))
    assert [s[i] for i in order] == sorted(s)
    assert all(lcp[k] == suffix_dedup.common_prefix(s[order[k - 1]], s[order[k]]) for k in range(1, len(s)))


def test_classifier_tells_bad_texts_apart(spark, empty):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, words(r, 60, 300) + (" awful " + words(r, 3, 300)) * 2 * bad))
        labels.append((i, 1, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"] for x in importance.classify(d, lab).where("kept").collect()}
    held_out = range(400, 600)
    assert sum((i in kept) == (i % 5 != 0) for i in held_out) >= 196
    assert importance.classify(empty.select("doc_id", "text"), lab).count() == 0
    assert importance.classify(d, lab.where("false")).where("kept").count() == 600


def test_kth_largest(spark):
    values = [random.Random(7).gauss(0, 1) for _ in range(500)] + [0.5] * 20
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 17, 260, 520):
        assert importance.kth_largest(df, "v", k, bins=8) == sorted(values, reverse=True)[k - 1]


@pytest.mark.parametrize("ids", [[], [5], list(range(9000)), [7, 8, 9] * 3000, [0] * 5000 + [49407] * 5000])
def test_token_frames(ids):
    ids = np.array(ids, np.int64)
    frame = token_files.pack(ids)
    assert (token_files.unpack(frame) == ids).all()
    if len(ids) > token_files.BLOCK:
        assert (token_files.unpack(frame, 1) == ids[token_files.BLOCK : 2 * token_files.BLOCK]).all()
        broken = bytearray(frame)
        broken[len(frame) // 2] ^= 255
        with pytest.raises(ValueError):
            token_files.unpack(bytes(broken))


def test_token_files_round_trip(spark, docs, tmp_path):
    path = tokenizer_file("word_bpe_49k.json")
    token_files.write_tokens(docs, f"file://{tmp_path}/t", path, frame=500)
    t, at = token_counts.tokenizer(path)[0], 0
    got = {r["doc_id"]: r for r in token_files.token_digests(spark, f"file://{tmp_path}/t").collect()}
    for i, text, *_ in sorted(corpus()):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_counts(spark, docs, empty):
    path = tokenizer_file("byte_bpe_50k.json")
    t = token_counts.tokenizer(path)[0]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x, *_ in corpus()}
    assert token_counts.count_tokens(empty, path).count() == 0


def test_overlaps_resynchronise():
    t = token_counts.tokenizer(tokenizer_file("byte_bpe_50k.json"))[0]
    encode, r = (lambda x: t.encode(x, add_special_tokens=False).offsets), random.Random(8)
    parts = ["a", "the", " ", "  ", "\n", "é", "'s", "12", "!!", "日本", "　", "hello world "]
    for _ in range(60):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 400)))
        assert token_counts.count_huge(encode, x, 64, 8) == len(encode(x))
    assert token_counts.count_huge(encode, "a" * 5000, 64, 8) == len(encode("a" * 5000))


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    s = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepiece_codec.encode_texts(docs.withColumn("ids", F.lit(1)), path, whole_rows=True).collect():
        assert r["ids"] == s.encode(r["row"]["text"] or "") and r["decoded"] == (r["row"]["text"] or "") and r["row"]["ids"] == 1
    c, r = sentencepiece_codec.codec(path), random.Random(9)
    parts = ["a", "th", " ", "    ", "\n", "é", "𝄞", "<s>", "▁", "ing", "\x00"]
    odd = ["".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(400)] + ["ab" * 4000]
    assert [x.tolist() for x in c.encode(odd)] == s.encode(odd)
    assert sentencepiece_codec.encode_texts(empty, path).count() == 0


def brute_rules(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(runs)
    hit = {k for i, x in enumerate(runs) if n[x] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, empty):
    r = random.Random(10)
    rows = corpus() + [(100 + i, "\n".join(r.choice(["one two three four five six", "#$ a", "", " "]) for _ in range(20)), None, "s", 0) for i in range(10)]
    for x in quality_rules.apply_rules(spark.createDataFrame(rows, DOCS)).collect():
        want = brute_rules({i: t for i, t, *_ in rows}[x["doc_id"]])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (x["base_failed"] and x["kept"])
    assert quality_rules.apply_rules(empty).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|turn|>user<|end|>\n", "a\\b\\\\", "<\\|", None, "", "𝄞é", "<|", "\\", "x\n<|next|>"]
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", None]), r.choice(odd)) for c in [*range(20), None] for t in range(r.randint(1, 9))]
    got = {x["conv_id"]: x for x in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in {x[0] for x in rows}:
        own = sorted((t, role or "", text or "") for cc, t, role, text in rows if cc == c)
        told, loss = "".join(f"{role}\n{text}\n" for _, role, text in own), "".join(text for _, role, text in own if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("chars", [4_000_000, 300])
def test_decontamination(spark, empty, chars):
    r = random.Random(12)
    items = [(i, words(r, n, 30)) for i, n in enumerate([20, 3, 13, 1, 40])] + [(9, ""), (10, None)]
    rows = [(i, words(r, 40, 30) + ". " + (items[i % 5][1] or "").upper() + ", " + words(r, 5, 30)) for i in range(25)] + [(90, None), (91, "")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    for x in decontaminate.find_contamination(d, b, automaton_chars=chars).collect():
        w, hit, found = split(dict(rows)[x["doc_id"]]), set(), set()
        for i, t in items:
            v = split(t)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(i))
        assert (x["n_words"], x["n_hit"], x["items"]) == (len(w), len(hit), sorted(found))
    assert decontaminate.find_contamination(empty, b).count() == 0


def test_pipeline_drops_every_full_benchmark_window(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(24)
    items = [(1, words(r, 20, 10**6)), (2, "short item of five words"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain, item = words(r, 1500, 10**6), items[0][1].split()
    rows = [(1, plain), (2, f"{plain} {items[0][1]}"), (3, f"{' '.join(item[3:16]).upper()}. {plain}"), (4, f"{' '.join(item[3:15])} {plain}"), (5, f"{plain} {items[1][1]}"), (6, f"{words(r, 20, 10**6)} {items[1][1]}"), (7, None)]
    left = P.benchmark_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(x["doc_id"] for x in left.collect()) == [1, 4, 5, 7]


def test_licenses(spark, empty):
    rows = [(1, "Text.\nReleased under the MIT License."), (2, "GNU General  Public-License and Apache license; cc by"), (3, None), (4, "license cc"), (5, "x\nAll RIGHTS reserved.\nno"), (6, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["labels"]) == (1, 4, "mit", "mit,mit-notice")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (3, 0, 7, "apache,cc-by,gpl")
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["score"]) == (0, 0, None, 0.0)
    assert got[4]["labels"] == "" and got[5]["labels"] == "all-rights-reserved" and "cc-by-nc" in got[6]["labels"]
    assert licenses.scan_licenses(empty).count() == 0


def test_license_join_equals_brute_force(spark):
    r = random.Random(13)
    sets = licenses.template_sets()
    rows = [(i, "\n".join(" ".join(r.sample(s, r.randint(len(s) // 2, len(s)))) for _, s in r.sample(sets, 3))) for i in range(30)]
    for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = sorted((k, label) for k, line in enumerate(dict(rows)[x["doc_id"]].split("\n")) for label, s in sets if len(set(line.split()) & set(s)) >= 0.8 * len(s) - 1e-9)
        assert sorted((b["line"], b["label"]) for b in x["blocks"] or []) == want


def test_notices_wrapped_over_lines_are_found(spark):
    import textwrap

    sets, rows = licenses.template_sets(), []
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        wrapped = textwrap.fill(text, 30)
        rows += [(3 * i, f"Plain text.\n \n{wrapped}\n\nmore"), (3 * i + 1, "\r\n".join("# " + x for x in wrapped.split("\n"))), (3 * i + 2, wrapped.replace("\n", "\n\n"))]
    for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[x["doc_id"]].lower()
        blocks = text.split("\n") + re.split(r"\n\s*\n", text)
        held = [set(re.findall("[0-9a-z]+", b)) for b in blocks]
        want = {label for label, s in sets if any(len(h & set(s)) >= 0.8 * len(s) - 1e-9 for h in held)}
        assert want | set(filter(None, x["base_labels"].split(","))) == set(filter(None, x["labels"].split(",")))
        assert x["doc_id"] % 3 == 2 or licenses.TEMPLATES[x["doc_id"] // 3][0] in want


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cols, before = d.columns, d.count()
    for name, stage in P.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, "/root/testdata/sf0.001").toPandas(), d.schema)
        assert d.columns == cols and 0 < d.count() <= before, name
        before = d.count()
    out = P.STAGES[-1][1](spark, d, "/root/testdata/sf0.001")
    assert out.count() == before and out.where("not round_trip").count() == 0
