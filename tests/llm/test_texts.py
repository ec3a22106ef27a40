import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import common, exact_dedup, jaccard, registry, toxicity, warc
from tessera.llm.bpe import ByteCodec, bpe_round_trip
from tessera.llm.chat import CONTROL, chat_windows, digests, escape, format_window, spans, unescape
from tessera.llm.chat import size as chat_size
from tessera.llm.exact_dedup import Directory, exact_groups
from tessera.llm.jaccard import near_groups
from tessera.llm.licenses import PHRASES, TEMPLATES, families, license_scan
from tessera.llm.packing import pack, windows
from tessera.llm.token_counts import UnigramCounter, token_counts

ODD = [None, "", " ", "  a  b\n\n c\t d e \x1c f\x85g", "a<|endoftext|>b <|endoftext|>", "it's WE'LL 12²3 ½ é naïve 日本語 😀😀 İ ſ", "x" * 3000 + "-" * 200 + " " * 50 + "q", "foo \nbar  \n  baz\n \nq  ", "the cat sat on the mat. " * 2000]


def docs(spark, texts=ODD, extra=True):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + ([(None, "null key", "y", 0), (1, "", "z", 0)] if extra else [])
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, kept int")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_bpe_equals_the_library(spark):
    path = f"{registry.TOKENIZERS}/byte_bpe_50k.json"
    library = Tokenizer.from_file(path)
    df = docs(spark)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    got = [tuple(r) for r in bpe_round_trip(df, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe_round_trip(empty(spark), path).count() == 0


def test_bpe_of_one_very_long_word():
    path = f"{registry.TOKENIZERS}/byte_bpe_50k.json"
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    ids, ends = ByteCodec(path).encode(pa.array([word, None, word[:9]]))
    library = Tokenizer.from_file(path)
    assert ids[: ends[0]].tolist() == library.encode(word, add_special_tokens=False).ids
    assert ends[1] == ends[0] and ids[ends[1] :].tolist() == library.encode(word[:9], add_special_tokens=False).ids


def test_packing_keeps_every_id(spark):
    path = f"{registry.TOKENIZERS}/word_bpe_49k.json"
    library = Tokenizer.from_file(path)
    df = docs(spark, extra=False)
    rows = pack(df, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in df.collect():
        own = sorted(by_doc[r.doc_id], key=lambda x: x.start)
        ids = np.frombuffer(b"".join(bytes(x.ids) for x in own), "<u4").tolist()
        assert ids == library.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert [x.start for x in own] == np.cumsum([0] + [x.length for x in own])[:-1].tolist()
        assert all(x.doc_tokens == len(ids) for x in own)
    for own in by_sequence.values():
        own = sorted(own, key=lambda x: x.offset)
        assert [x.offset for x in own] == np.cumsum([0] + [x.length for x in own])[:-1].tolist() and sum(x.length for x in own) <= 2048
    assert pack(empty(spark), path).count() == 0


def test_windows_are_near_equal():
    rng = random.Random(1)
    sizes = [rng.randint(100, 512) for _ in range(600)]
    parts = windows(sizes, 2048)
    loads = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(600)) and max(loads) <= 2048
    assert len(parts) <= 1.02 * sum(sizes) / 2048 + 1 and windows([], 2048) == [] and windows([2048, 2048], 2048) in ([[0], [1]], [[1], [0]])


def test_unigram_counts_equal_a_plain_search(spark):
    path = f"{registry.TOKENIZERS}/piece_bpe_32k.model"
    own = UnigramCounter(path)
    words = sorted({w for t in ODD for w in (t or "").split()} | {"hello", "help", "helping", "ñandú"})

    def plain(word):
        word = "▁" + word
        best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
        for end in range(1, len(word) + 1):
            options = [(best[a][0] + own.scores[word[a:end]], -(best[a][1] + 1)) for a in range(max(0, end - 20), end) if word[a:end] in own.scores]
            if word[end - 1] not in own.scores:
                n = len(word[end - 1].encode())
                options.append((best[end - 1][0] + n * own.byte_score, -(best[end - 1][1] + n)))
            best[end] = max(options)
            best[end] = best[end][0], -best[end][1]
        return best[-1][1], best[-1][0]

    words = [w for w in words if len(w) < 100]
    got = own.count(words)
    for w in words:
        assert got[w][0] == plain(w)[0] and got[w][1] == pytest.approx(plain(w)[1])
    rows = token_counts(docs(spark), path).collect()
    assert len(rows) == len(ODD) + 2 and [(r.n_words, r.n_tokens) for r in rows if r.doc_id in (0, 2)] == [(0, 0)] * 2


@pytest.mark.parametrize("bits, hot, broadcast", [(64, 10_000, 200_000), (2, 10_000, 0), (64, 4, 200_000), (1, 2, 0)])
def test_exact_groups(spark, monkeypatch, bits, hot, broadcast):
    for name, value in (("HELD_ENTRIES", 1), ("HOT_ROWS", hot), ("BROADCAST_ROWS", broadcast), ("BROADCAST_BYTES", broadcast), ("OWNER_ROWS", 5)):
        monkeypatch.setattr(exact_dedup, name, value)
    texts = ["a", "a", "b", None, "", "A", "a ", "long " * 5000, "long " * 5000] + [f"t{i % 7}" for i in range(40)]
    df = docs(spark, texts)
    df = df.union(df.where("doc_id in (0, 20, 21) or doc_id is null")).repartition(5)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    got = [tuple(r) for r in exact_groups(df, capacity=3, hash_bits=bits).collect()]
    groups = {}
    for k, t in rows:
        groups.setdefault(t, []).append(k)
    assert sorted((k, n, s) for k, _, n, _, s in got if k is not None) == sorted((k, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in rows if k is not None)
    for t, keys in groups.items():
        own = [g for g in got if g[4] == hashlib.sha256(t.encode()).hexdigest()]
        known = [k for k in keys if k is not None]
        assert sum(g[3] for g in own) == 1 and {g[1] for g in own} == {max(known, default=None)}
        assert [g[0] for g in own if g[3]] == [max(known, default=None)]
    assert exact_groups(empty(spark)).count() == 0


def test_directory_splits_only_full_buckets():
    counts = np.zeros(16, np.int64)
    counts[0], counts[1], counts[9] = 10, 10, 3
    d = Directory.of(counts, 12)
    assert d.depth == 4 and len(set(d.cells)) == 6 - 1 and d.cells[8] == (1, 1) and d.cells[0] == (4, 0)
    assert Directory.of(np.zeros(4, np.int64), 1).depth == 0


def test_license_scan_equals_plain_search(spark):
    first = " ".join(TEMPLATES[0][1].split()[:-1])
    texts = ODD + ["CC BY NC cc-by-nc  É under the MIT license Apache License, Version 2.0", "foo " * 100 + TEMPLATES[3][1].replace(" ", "\n") + " bar" * 70, "x " * 30 + first.upper() + " y" * 50, "license mit the under"]
    texts += [" z" * 55 + " " + next(t for x, t in TEMPLATES if x == label) + " z" * 90 for label in ("gpl", "lgpl", "cc-by-sa", "cc-by")]
    df = docs(spark, texts)
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for r in df.collect():
        w = words_of(r.text)
        places = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base, labels = {x for _, x in places}, {x for _, x in places}
        kin = families([*PHRASES, *(t for _, t in TEMPLATES)], 0.8)[len(PHRASES) :]
        best = {}
        for (label, t), family in zip(TEMPLATES, kin):
            for b in range(0, len(w), 64):
                n = len(set(t.split()) & set(w[b : b + 128]))
                if n >= 0.8 * len(set(t.split())):
                    best[family, b] = max(best.get((family, b), (0, 0, "")), (n / len(set(t.split())), n, label))
        labels |= {x[2] for (f, b), x in best.items() if all(best.get((f, c), (0, 0))[:2] <= x[:2] for c in (b - 64, b + 64))}
        starts = [k for k, _ in places]
        want.append((r.doc_id, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels))))
    got = [tuple(r)[:-1] for r in license_scan(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(g[2] for g in got) == 4
    assert [dict((g[0], g[6]) for g in got)[len(ODD) + 4 + k] for k in range(4)] == ["gpl", "lgpl", "cc-by-sa", "cc-by"]
    assert license_scan(empty(spark)).count() == 0


@pytest.mark.parametrize("meeting, leaders, turns, broadcast, again", [(48, 8, 6, 200_000, 4096), (3, 1, 1, 0, 0), (2, 2, 0, 200_000, 4096), (2, 1, 0, 10, 1)])
def test_near_groups_equal_brute_force(spark, monkeypatch, meeting, leaders, turns, broadcast, again):
    for name, value in (("MEETING", meeting), ("LEADERS", leaders), ("TURNS", turns), ("AGAIN", again)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    base = [[word() for _ in range(rng.choice([3, 30, 120]))] for _ in range(12)]
    texts = [None, "", "a b", "A  b", "a b c", "a b c"]
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    df = docs(spark, texts).repartition(4)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    want = []
    for i, (k, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        want.append((k, len(sets[i]), min(keys, default=None)))
    got = [tuple(r)[:3] for r in near_groups(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert near_groups(empty(spark)).count() == 0


def test_chat_round_trip(spark):
    for t in ["", "\\", "<|>", "a</s>[INST]\\.[/INST]<<SYS>><|turn|>", "\\.<\\|", *CONTROL]:
        assert unescape(escape(t)) == t and not any(c in escape(t) for c in CONTROL)
    turns = [(1, 0, "system", "be <|end|> brief"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, None, None), (3, None, "assistant", "")]
    turns += [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i % 90)) for i in range(1, 1200)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = {r.conv_id: r for r in digests(chat_windows(df)).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1]))
        all_text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(all_text.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert spans([5, 50, 50, 50], ["system", "user", "assistant", "user"], 120, 60) == [(0, 0, 3), (2, 3, 4)]


def test_chat_windows_are_whole_whatever_the_turn_numbers(spark):
    rng = random.Random(6)
    says = lambda i: "word " * rng.choice([0, 1, 5, 30, 90, 200, 600]) + str(i)
    turns = {(c, i * step): (("user", "assistant")[i % 2], says(i)) for c, n, step in ((1, 1200, 1), (2, 60, 1000), (3, 700, 7), (None, 20, 600)) for i in range(n)}
    turns |= {(2, 0): ("system", "be brief " * 20), (4, 5): ("system", "alone")}
    df = spark.createDataFrame([(c, i, *t) for (c, i), t in turns.items()], "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = sorted(map(tuple, chat_windows(df).select("conv_id", "window", "formatted", "loss", "fresh").collect()), key=lambda r: (r[0] or 0, r[1]))
    want = []
    for c in (None, 1, 2, 3, 4):
        own = [turns[k] for k in sorted((k for k in turns if k[0] == c), key=lambda k: k[1])]
        for k, (first, new, end) in enumerate(spans([chat_size(t) for _, t in own], [r for r, _ in own], 512, 128)):
            shown = ([0] if first and own[0][0] == "system" else []) + list(range(first, end))
            want.append((c, k, *format_window(own, shown, new)))
    assert got == want


def test_warc_round_trip(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "a\r\nb", inner * 3), (6, "u6", "é" * 70000), (None, "n", "same")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    got = {r.key: r for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert len(got) == 7
    for key, _, html in pages:
        raw = (html or "").encode()
        assert got[key].payload_bytes == len(raw) and got[key].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(k, got[k].record_type, got[k].refers_to) for k in (1, 2, 3, 4, None)] == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 2)]
    assert bytes(got[5].payload).decode() == inner * 3


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = int(i % 6 == 0)
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["zzvile", "zzrude", "zzfoul"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    df = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "zzvile zzrude")], "doc_id bigint, text string")
    known = spark.createDataFrame([*labels, (None, 1), (9000, None)], "doc_id bigint, toxic int")
    out = toxicity.score(df, toxicity.fit(df, known)).select("row.doc_id", "score", "predicted").collect()
    truth = dict(labels)
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in out if r.doc_id in (9000, 9001)) and len(out) == 603


def test_segments_equal_plain_search():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 14)
        places = sorted(rng.sample(range(30), n))
        # odd multiples of powers of two of their own make every stretch's sum differ, so places are definite
        scores = [rng.choice([-2.0, -1.0, 1.0, 3.0]) + 2.0 ** -(k + 8) for k in range(n)]
        line = [-1.0] * (places[-1] + 1)
        for k, at in enumerate(places):
            line[at] = scores[k]

        def maximal(a, b):
            if a >= b:
                return []
            best = max(((sum(line[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return maximal(a, i) + [(i, j - 1, best[0])] + maximal(j, b)

        got = toxicity.segments(scores, places, 1.0)
        want = maximal(0, len(line))
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_segments_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        toxicity.segments([1.0] * n, [5 * i for i in range(n)], 1.0)
        return time.perf_counter() - began

    assert min(seconds(64_000) for _ in range(3)) < 25 * max(1e-3, min(seconds(8_000) for _ in range(3)))


def test_scores_equal_a_plain_version(spark):
    model = toxicity.ToxicityModel({"vile": 2.0, "rude": 1.5, "calm": -0.5}, {"zzvil": 3.0}, rate=0.7, size=0.05, offset=-3.0, slope=0.6)
    rng = random.Random(8)
    texts = [None, "", " ... ", "calm"] + [" ".join(rng.choice(["vile", "Rude,", "calm", "x", "zzvile", "é"]) for _ in range(rng.choice([1, 5, 30, 400]))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)] + [(None, "vile", 0.1, "y"), (3, "calm", 0.1, "y")], "doc_id bigint, text string, score double, passages string").repartition(3)
    value = {"vile": 2.0, "rude": 1.5, "calm": -0.5, "zzvile": 3.0}
    for r in toxicity.score(df, model).collect():
        words = re.findall(r"[^\W_]+", (r.row.text or "").lower())
        hits = [(value[w], k) for k, w in enumerate(words) if value.get(w, -1.0) > 0]
        noise = [(value.get(w, -1.0), k) for k, w in enumerate(words)]
        evidence = 0.0
        if hits:
            for _, _, s in toxicity.segments([x for x, _ in noise], [k for _, k in noise], 1.0):
                evidence += max(0.0, 0.7 * s - np.log(0.05 * len(words)))
        want = 1 / (1 + np.exp(3.0 - 0.6 * min(evidence, 20.0)))
        assert r.score == pytest.approx(want) and r.predicted == int(r.score >= 0.3)
    assert toxicity.score(df.limit(0), model).count() == 0
    none = toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert none.words == {} and toxicity.score(df, none).where("predicted = 1").count() == 0


def test_the_law_of_extreme_values_is_found():
    rng = np.random.default_rng(3)
    words = rng.integers(50, 2000, 4000)
    best = np.maximum(0, (np.log(0.02 * words) + rng.gumbel(size=4000)) / 0.8)
    rate, size = toxicity.extreme_values(best, words)
    assert rate == pytest.approx(0.8, rel=0.1) and size == pytest.approx(0.02, rel=0.3)
    assert toxicity.extreme_values(np.zeros(3), np.ones(3))[0] == 1.0
