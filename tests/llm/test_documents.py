"""Operators 2, 4, 6, 8 and 9 on documents."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import address_spans, base_spans, documents, overlaps, same, secret_spans, WORD

from voltweave.llm import decontaminate, language, packing, pii, quality


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_overlaps_tolerate_substitutions_and_leave_clean_text(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    item = [word() for _ in range(40)]
    changed = list(item)
    for k in (4, 11, 19, 27, 33):
        changed[k] = word()
    half = [w if k % 2 else word() for k, w in enumerate(item)]
    noise = lambda n: [word() for _ in range(n)]
    rows = [
        (1, " ".join(noise(50) + item + noise(9))), (2, " ".join(noise(7) + changed + noise(70))), (3, " ".join(noise(300))), (4, " ".join(noise(5) + item[3:12] + noise(5))), (5, " ".join(noise(5) + half)),
        (6, None), (7, ""), (8, " ".join(w.upper() + "," for w in item)), (8, " ".join(w.upper() + "," for w in item)), (9, " ".join(item[10:30])),
    ]
    got = decontaminate.find_overlaps(documents(spark, rows, extra=True), bench(spark, [(70, " ".join(item)), (71, None), (72, "short one"), (None, " ".join(item))]))
    assert sorted((r["doc_id"], r["item_id"], r["n_aligned"], r["n_agree"]) for r in got.collect()) == [(1, 70, 40, 40), (2, 70, 40, 35), (8, 70, 40, 40), (8, 70, 40, 40), (9, 70, 20, 20)]
    kept = decontaminate.drop_contaminated(documents(spark, rows, extra=True), bench(spark, [(70, " ".join(item))]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7]


def test_agreeing_tokens_beside_an_overlap_do_not_hide_it(spark):
    item = [f"i{k}" for k in range(150)]
    other = lambda n: [f"d{k}" for k in range(n)]
    short = other(20) + item[20:33] + other(4) + item[37:38] + other(20)
    loose = other(5) + item[10:70] + [w if k % 2 else "z" for k, w in enumerate(item[70:130])] + other(5)
    got = decontaminate.find_overlaps(documents(spark, [(1, " ".join(short)), (2, " ".join(loose))]), bench(spark, [(70, " ".join(item))]))
    found = {r["doc_id"]: tuple(r)[2:] for r in got.collect()}
    assert found[1] == (20, 13, 13)
    assert found[2][0] == 5 and found[2][2] > 60 and 5 * found[2][2] >= 4 * found[2][1]


def test_items_without_an_id_take_documents_out(spark):
    item = " ".join(f"i{k}" for k in range(20))
    docs = documents(spark, [(1, "a b " + item), (2, "clean text"), (3, "say tiny words")], extra=True)
    kept = decontaminate.drop_contaminated(docs, bench(spark, [(None, item), (None, "tiny words"), (None, None), (7, "other")]))
    assert [r["doc_id"] for r in kept.collect()] == [2]
    assert decontaminate.drop_contaminated(docs, bench(spark, [(None, None)])).count() == 3


def test_every_accepted_substitution_has_a_seed():
    percent, bits = decontaminate.AGREE_PERCENT, [int(m, 2) for m in decontaminate.MASKS]
    # Long items: the best score of a pattern without a seed, by its last positions, for each length.
    width = max(map(len, decontaminate.MASKS)) - 1
    states, best = np.arange(1 << width), np.full(1 << width, -(10**9))
    best[1] = 100 - percent
    for length in range(2, 400):
        new = np.full_like(best, -(10**9))
        for bit, score in ((0, -percent), (1, 100 - percent)):
            seen = states << 1 | bit
            free = ~np.logical_or.reduce([(seen & b) == b for b in bits])
            np.maximum.at(new, (seen & ((1 << width) - 1))[free], (best + score)[free])
        best = new
        assert length < decontaminate.LEAST_TOKENS or best[1::2].max() < 0, length
    assert sorted(decontaminate.SHORT_MASKS) == list(range(1, decontaminate.LEAST_TOKENS))
    for n, masks in decontaminate.SHORT_MASKS.items():
        for r in range(n * (100 - percent) // 100 + 1):
            for gone in itertools.combinations(range(1, n - 1), r):
                kept = "".join("0" if k in gone else "1" for k in range(n))
                assert any((int(kept[o : o + len(m)], 2) & int(m, 2)) == int(m, 2) for m in masks for o in range(n - len(m) + 1)), kept


def test_short_items_match_as_a_whole(spark):
    items, rows, wanted = [], [], set()
    for n in [*range(1, 13), 15]:
        item = [f"n{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for r in range(n // 5 + 1):
            for gone in itertools.combinations(range(1, n - 1), r):
                text = ["other"] * 3 + item[: n - 1] + ["other"] * 2 + ["sub" if k in gone else w for k, w in enumerate(item)] + ["end"]
                rows.append((len(rows), " ".join(text)))
                wanted.add((len(rows) - 1, n, n + 4, n, n - r))
        for cut in ([item[1:], item[:-1]] if n > 1 else []):
            rows.append((len(rows), " ".join(["other", *cut, "end"])))
    got = {tuple(r) for r in decontaminate.find_overlaps(documents(spark, rows), bench(spark, items)).collect()}
    assert {x for x in got if x[1] < 13} == {x for x in wanted if x[1] < 13}
    assert {x[:2] for x in wanted} <= {x[:2] for x in got}
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(documents(spark, rows), bench(spark, items)).collect()}
    assert kept == {k for k, _ in rows} - {x[0] for x in got}


def test_best_stretch_equals_plain_search():
    rng = np.random.default_rng(3)
    for least in (1, 5, 13):
        for share in (0.4, 0.6, 0.8, 0.95):
            for _ in range(60):
                agree = rng.random(45) < share
                hits = np.flatnonzero(agree).tolist()
                chain = {h: k for k, h in enumerate(hits)}
                cut = [0] + [k for k in range(1, len(hits)) if hits[k] - hits[k - 1] > decontaminate.DROP + 1] + [len(hits)]
                wanted = []
                for a, b in zip(cut, cut[1:], strict=False):
                    all_ = [(s, e - s + 1, chain[e] - chain[s] + 1) for s in hits[a:b] for e in hits[a:b] if e >= s]
                    good = [x for x in all_ if x[1] >= least and 100 * x[2] >= decontaminate.AGREE_PERCENT * x[1]]
                    wanted += [min(good, key=lambda x: (-x[2], x[0]))] if good else []
                assert decontaminate.stretches(agree, least) == wanted


def test_overlaps_equal_brute_force(spark, table_rows, small):
    import pyarrow.parquet as pq

    rng = random.Random(2)
    items = list(map(tuple, zip(*pq.read_table(f"{small}/benchmark.parquet", columns=["item_id", "text"]).to_pydict().values(), strict=True)))[:40]
    words = [f"w{k}" for k in range(12)]
    items += [(900 + k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([1, 2, 4, 5, 7, 9, 12, 13, 20, 40, 60])]
    docs = [(d, t) for d, t in table_rows if t and len(t) < 4000][:60]
    docs += [(5000 + k, " ".join(w if rng.random() < 0.9 else "other" for w in rng.choice(items)[1].split() + rng.choices(words, k=20))) for k in range(40)]
    got = {(r["doc_id"], r["item_id"]): r["n_agree"] for r in decontaminate.find_overlaps(documents(spark, docs), bench(spark, items)).collect()}
    wanted = overlaps(docs, items)
    assert wanted and got == wanted


def test_a_common_opening_is_verified_in_arrays():
    import pyarrow as pa

    opening = " ".join(f"o{k}" for k in range(9))
    index = decontaminate.Seeds([(k, opening + " " + " ".join(f"i{k}x{j}" for j in range(30))) for k in range(4000)])
    text = " ".join([opening, *(f"z{k}" for k in range(500))] * 3)
    block = next(iter(decontaminate.B.blocks(pa.record_batch([pa.array([1]), pa.array([text + " " + opening + " " + " ".join(f"i7x{j}" for j in range(30))])], names=["doc_id", "text"]))))
    import time

    began = time.process_time()
    assert index.matches(block) == {(0, 7): (3 * 509, 39, 39)}
    assert time.process_time() - began < 2


def test_blocks_of_items_give_the_same_overlaps(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    once, many = (sorted(map(tuple, decontaminate.find_overlaps(docs, items, n).collect())) for n in (1 << 20, 700))
    assert once == many and once
    assert decontaminate.find_overlaps(docs, items.limit(0)).count() == 0 and decontaminate.find_overlaps(docs.limit(0), items).count() == 0


def test_overlaps_contain_every_item_found_by_plain_search(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet").collect(), spark.read.parquet(f"{small}/benchmark.parquet").collect()
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) + " "
    texts = [(d["doc_id"], plain(d["text"])) for d in docs]
    wanted = {(d, i["item_id"]) for i in items for d, t in texts if plain(i["text"]) in t}
    got = decontaminate.find_overlaps(spark.createDataFrame(docs), spark.createDataFrame(items))
    assert wanted and wanted <= {(r["doc_id"], r["item_id"]) for r in got.collect()}


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    rep = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def test_quality_counts(spark, corner_rows, table_rows):
    for rows in (corner_rows, table_rows):
        got = quality.judge(documents(spark, rows, extra=True).repartition(3)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        same(got.collect(), [(d, *plain_counts(t)) for d, t in rows])
    assert quality.judge(documents(spark, [])).count() == 0 and quality.keep_documents(documents(spark, [])).count() == 0


def test_bad_host_loses_all_and_small_host_is_shrunk(spark):
    good, bad = " ".join(f"w{k}" for k in range(30)), "too short"
    rows = [(k, good if k % 10 else bad, "good") for k in range(100)] + [(100 + k, bad if k % 10 else good, "spam") for k in range(100)] + [(300, bad, "tiny"), (301, good, None), (302, good, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality.judge(df).where("kept").collect()}
    assert kept == {k for k in range(100) if k % 10} | {301, 302}
    out = quality.keep_documents(df)
    assert {r["doc_id"] for r in out.collect()} == kept and out.columns == df.columns


def test_personal_data_equals_the_expressions(spark, corner_rows, table_rows):
    made = [
        (90, "a@b@c.d x.@y.z. a@b.c.d@e.f"), (91, "1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.0 1.2.3"), (92, "4111 1111 1111 1111 4111-1111-1111-1112 49927398716 4111111111111111-"), (93, "+1 (555) 123-4567 +49..30 12345 6 + 1 +1234567890123456 +123-"),
        (94, "é@x.de ü 1.1.1.1 ñ+1 555 555 5555"), (95, "0" * 13 + " " + "9" * 40), (96, "x@y.com" * 5), (97, "000.0000.001.255"),
    ]
    for rows in (corner_rows, made, table_rows):
        got = pii.find_private(documents(spark, rows, extra=True)).collect()
        wanted = []
        for d, t in rows:
            spans = base_spans(t or "")
            count = Counter(k for k, *_ in spans)
            wanted.append((d, *(count[k] for k in pii.BASE_KINDS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
        same([tuple(r)[:6] for r in got], wanted)
        assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) == sum(r[f"n_{k}"] for k in pii.KINDS) for r in got)


def test_long_runs_take_linear_time():
    import time

    for text in ("7" * 400_000, "1 " * 200_000, "1.1." * 100_000, "+1" * 200_000, "a@" * 200_000, "1-" * 200_000 + "x", "+" + "1 " * 200_000, "a@b." * 100_000, "www." * 100_000, "iban " * 80_000, "token=" * 80_000, "token" * 80_000):
        began = time.process_time()
        pii.find(text)
        assert time.process_time() - began < 20


def test_added_spans_equal_plain_expressions(spark, table_rows):
    """Web addresses by an expression of their own; the other added kinds by their cues."""
    told = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" my_secret:abcdefghijklmnopqrst1 Password => "short1" tokens = 0123456789abcdef0 API_KEY: 0123456789012345678 pwd=aaaaaaaaaaaaaaaaaaaaa atoken=0123456789abcdef0'
    for _, text in [*table_rows, (0, "x www.a.b, (http://c.d/e?f) mailto:g@h.i. awww.no www. http:// _www.x.y"), (1, told)]:
        assert pii.find(text or "")["url"] == [(s, e) for _, s, e in address_spans(text or "")]
        assert pii.find(text or "")["secret"] == [(s, e) for _, s, e in secret_spans(text or "")]
        for s, e in pii.find(text or "")["account"]:
            assert re.search(r"(?i)iban|account|acct|konto|cuenta|compte|A[KS]IA", text[max(0, s - 30) : e])


def test_more_personal_data_and_redaction(spark):
    text = "See https://example.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, IBAN DE00 3704 0044 0532 0130 00; account no: 12345678 AKIA" + "A" * 16 + " me@x.org"
    spans = pii.find(text)
    assert [text[s:e] for s, e in spans["url"]] == ["https://example.org/a?b=1"]
    assert [text[s:e] for s, e in spans["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678", "AKIA" + "A" * 16]
    told = 'un token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" enon; the password: none, secret=abc'
    assert pii.redact(told) == 'un token = "[SECRET]" enon; the password: none, secret=abc'
    rows = [(1, text), (2, None), (3, "clean text"), (4, "")]
    out = {r["doc_id"]: r for r in pii.redact_private(documents(spark, rows, extra=True)).collect()}
    assert "[EMAIL]" in out[1]["text"] and "me@x.org" not in out[1]["text"] and "[URL]" in out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "clean text" and out[4]["text"] == ""
    assert pii.redact_private(documents(spark, [])).count() == 0


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    return lambda texts: [np.array([*x.ids, 1], "<u4") for x in model.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, got, ids):
    wanted = Counter()
    for (d, _), x in zip(rows, ids([t or "" for _, t in rows]), strict=True):
        wanted[d, len(x), x.tobytes()] += 1
    texts = {}
    for d, n, raw in wanted:
        texts.setdefault((d, n), []).append(np.frombuffer(raw, "<u4"))
    total = Counter()
    for r in got:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in texts[r["doc_id"], r["doc_tokens"]])
        total[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert total == {(d, n): n * sum(c for (a, b, _), c in wanted.items() if (a, b) == (d, n)) for d, n, _ in wanted}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0 and at == pieces[0]["sequence_tokens"]
    steps = {}
    for s in sequences.values():
        steps.setdefault(s[0]["step_id"], set()).add(s[0]["sequence_tokens"])
    assert all(len(x) == 1 for x in steps.values())


def test_packing_loses_no_id(spark, corner_rows, table_rows, ids):
    odd = [(50, "<|endoftext|> I'm don't 12345 ÀÉ á İ ΣΑΣ x y"), (51, "e" * 3000), (52, "́ ̸x")]
    for rows in (corner_rows, odd, table_rows):
        check_packing(rows, packing.pack_documents(documents(spark, rows, extra=True).coalesce(2)).collect(), ids)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_cache_of_words_may_be_cleared(spark, table_rows, ids, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    import pyarrow as pa

    from voltweave.llm import bytetext as B

    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    rows = table_rows[:60]
    batch = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    got = []
    for block in B.blocks(batch, limit=5000):
        flat, at = tokenizer(block)
        got += [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
    assert all((a == b).all() for a, b in zip(got, ids([t for _, t in rows]), strict=True))


def test_step_groups_are_even():
    rng = random.Random(6)
    steps = packing.Steps(16384)
    groups = {}
    for n in (1, 500, 3, 0, 90, 77):
        made = [(rng.choice([256, 1024, 2048]), [()] * rng.choice([1, 1, 2, 9, 30])) for _ in range(n)]
        for g, (size, pieces) in zip(steps.deal(made), made, strict=True):
            groups.setdefault(g, []).append((size, len(pieces)))
    by_size = {}
    for g in groups.values():
        assert len({size for size, _ in g}) == 1
        by_size.setdefault(g[0][0], []).append((len(g), sum(n for _, n in g)))
    for size, all_ in by_size.items():
        full = [n for k, n in all_ if k == 16384 // size]
        assert len(full) >= len(all_) - 1 and all(k <= 16384 // size for k, _ in all_)
        assert size == 256 or max(full) < 2.5 * sum(full) / len(full)


def test_pieces_give_the_tokenizers_ids(ids):
    """Letters, signs, contractions, special tokens, control characters and characters that need the tokenizer's own splitter."""
    import pyarrow as pa

    from voltweave.llm import bytetext as B

    rng = random.Random(5)
    texts = ["<|endoftext|> I'm don't x''s 12 a|b <|ENDOFTEXT|>", "×÷ Ã×b ÿß e\u0301 é\u0301 \x1ca\x7f 'tis", "", None, "A1B2--c..'d ²³ ª º ¼ µ"]
    texts += ["".join(rng.choices("aZ9'|<>é×ÉßÿÃ\u0301 \n.-_\x1c İ中1\xa0²", k=rng.randint(0, 30))) for _ in range(4000)]
    tokenizer, got = packing.WordTokenizer(packing.default_tokenizer()), []
    for block in B.blocks(pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"]), limit=20000):
        flat, at = tokenizer(block)
        got += [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
    assert all((a == b).all() for a, b in zip(got, ids([t or "" for t in texts]), strict=True))


def check_scores(spark, rows):
    got = language.score_documents(documents(spark, rows, extra=True).repartition(3)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    docs = [(d, [*WORD.findall((t or "").translate(low)), None]) for d, t in rows]
    c = Counter(w for d, ws in docs if crc(d) != 2 for w in ws)
    n, v = c.total(), len(c)
    wanted = [(d, crc(d) == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in docs]
    same([(*tuple(r)[:5], round(r["base_score"], 5)) for r in got], wanted)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    return got


def test_scores(spark, table_rows):
    got = check_scores(spark, table_rows)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_corner_cases(spark, corner_rows):
    check_scores(spark, corner_rows)
    assert language.score_documents(documents(spark, [])).count() == 0
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    assert [r["train_tokens"] for r in check_scores(spark, [(d, "a b c") for d in held])] == [0, 0, 0]


def test_rare_words_reach_their_counts_by_a_join(spark, table_rows, monkeypatch):
    monkeypatch.setattr(language, "TABLE_WORDS", 50)
    monkeypatch.setattr(language, "MODEL_WORDS", 30)
    check_scores(spark, table_rows[:80])


def small_network(seed=0):
    """Thirty words in classes of one to nine, the end, and all others."""
    at = np.minimum(np.cumsum([0, *[1 + k % 9 for k in range(language.CLASSES)]]), 30)
    at[-2:] = 31, 32
    at[-3] = 30
    shares = np.concatenate([np.log(np.full(n, 1 / n)) if n else np.zeros(0) for n in np.diff(at)])
    net = language.Network(language.Classes(np.arange(33), at, shares.astype(np.float32), np.where(np.diff(at) > 0, -3, language.NEVER).astype(np.float32)))
    rng = np.random.default_rng(seed)
    net.held[:] += rng.normal(0, 0.3, len(net.held))
    return net, rng


def test_gradient(monkeypatch):
    """Backpropagation against differences, the words' vectors included, and the state's reset at a document's start."""
    monkeypatch.setattr(language, "WORD_RATE", 0.0)
    net, rng = small_network()
    given, wanted = rng.integers(0, 30, (5, 3)), rng.integers(0, 32, (5, 3))
    given[0, 0] = given[3, 1] = net.words  # starts of documents
    given[given == 7] = 8  # never input
    wanted[2, 2] = 7
    keep, weight = (rng.random((5, 3)) < 0.7).astype(np.float32), (rng.random((5, 3)) < 0.8).astype(np.float32)
    start = rng.normal(0, 0.5, (3, language.HIDDEN)).astype(np.float32)

    def loss():
        h, total = start, 0.0
        for t in range(5):
            h = net.step(net.given(given[t]), h * keep[t][:, None])[0]
            logs = net.log_classes(h)[np.arange(3), net.class_of[wanted[t]]] + net.log_words(h, wanted[t])
            total -= float((logs * weight[t]).sum())
        return total

    def slope(values, k):
        old = values[k]
        values[k] = old + 1e-2
        up = loss()
        values[k] = old - 1e-2
        down = loss()
        values[k] = old
        return (up - down) / 2e-2

    grads = []
    net.update = lambda: grads.append(net.grad.copy())
    net.learn(given, wanted, keep, weight, start)
    grad = grads[0] * weight.sum()
    for k in rng.choice(np.flatnonzero(np.abs(grad) > 1e-2), 40, replace=False):
        assert abs(slope(net.flat, k) - grad[k]) < 0.02 * max(1, abs(grad[k]))
    monkeypatch.setattr(language, "WORD_RATE", 1e-4)
    low, high = next((a, b) for a, b in zip(net.classes.at, net.classes.at[1:], strict=False) if a <= 7 < b)
    times = int(((wanted >= low) & (wanted < high)).sum())
    output_rate = 1e-4 / np.sqrt(1 + times * np.exp(net.classes.shares[7]))
    wanted_slopes = {(row, j): slope(net.vectors, (row, j)) for row in (7, net.words) for j in range(3)} | {"b": slope(net.bias, 7)}
    before, bias = net.vectors.astype(np.float64), net.bias.astype(np.float64)
    net.learn(given, wanted, keep, weight, start)
    for (row, j), rate in (((row, j), rate) for row, rate in ((7, output_rate), (net.words, 1e-4 / np.sqrt(2))) for j in range(3)):
        moved = (before[row, j] - net.vectors[row, j]) / rate
        assert abs(moved - wanted_slopes[row, j]) < 0.03 * max(1, abs(moved))
    assert abs((bias[7] - net.bias[7]) / output_rate - wanted_slopes["b"]) < 0.03


def test_probabilities_sum_to_one(spark, table_rows):
    net, rng = small_network(3)
    h = np.tanh(rng.normal(0, 1, (20, language.HIDDEN))).astype(np.float32)
    total = sum(np.exp(net.log_classes(h)[np.arange(20), net.class_of[np.full(20, w)]] + net.log_words(h, np.full(20, w))) for w in range(32))
    assert np.abs(total - 1).max() < 1e-4
    c = Counter(w for _, t in table_rows for w in [*WORD.findall(t or ""), None])
    counts = spark.createDataFrame([(int(np.uint64(language.END).view(np.int64)) if w is None else hash(w), n) for w, n in c.items()], "word long, n long")
    table = language.make_table(counts)
    own = (table.numbers != language.REST_WORD).sum()
    in_model = int(table.counts[table.numbers != language.REST_WORD].sum())
    # Each other word has its count and one, and unseen words have one together.
    assert round(10**table.rest) == sum(c.values()) - in_model + len(c) - own + 1


def test_scores_are_probabilities_of_whole_documents():
    net, rng = small_network(1)
    docs = [rng.integers(0, 32, n) for n in (1, 40, 7, 7, 300)]
    got = net.score(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    for d, s in zip(docs, got, strict=True):
        h, x, total = np.zeros((1, language.HIDDEN), np.float32), net.words, 0.0
        for c in d:
            h = net.step(net.given(np.array([x])), h)[0]
            total += (net.log_classes(h)[0, net.class_of[c]] + net.log_words(h, np.array([c]))[0]) / np.log(10)
            x = c
        assert abs(total - s) < 1e-3


def test_streams_train_on_every_token_once_and_keep_states(monkeypatch):
    """What the network is given, in windows, equals the documents; a state is reset only where a stretch begins."""
    monkeypatch.setattr(language, "STRETCH", 50)
    net, rng = small_network(2)
    seen = []

    def learn(given, wanted, keep, weight, h, least):
        seen.append((given.copy(), wanted.copy(), keep.copy(), weight.copy(), h[:, 0].copy()))
        return h + weight.sum(axis=0)[:, None] * (keep.min(axis=0)[:, None] if len(keep) else 1)

    net.learn = learn
    streams = language.Streams(net, 4)
    docs = [rng.integers(0, 31, n) for n in [3, 170, 1, 60, 20, 20, 90, 5, 33, 400, 2]]
    for part in (docs[:5], docs[5:6], docs[6:]):
        streams.add(np.concatenate(part), np.concatenate([[0], np.cumsum([len(d) for d in part])]), False)
    streams.add(np.zeros(0, np.int64), np.zeros(1, np.int64), True)
    assert sum(int(w.sum()) for *_, w, _ in seen) == sum(map(len, docs))
    pairs = Counter()
    for given, wanted, keep, weight, _ in seen:
        for g, x, k, w in zip(given.ravel(), wanted.ravel(), keep.ravel(), weight.ravel(), strict=True):
            if w:
                assert (k == 0) == (g == net.words)
                pairs[int(g), int(x)] += 1
    wanted_pairs = Counter()
    for d in docs:
        for s in range(0, len(d), 50):
            part = d[s : s + 50].tolist()
            wanted_pairs.update(zip([net.words, *part], part))
    assert pairs == wanted_pairs
