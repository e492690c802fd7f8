"""Rules, classifier, token counts, packing, personal data, fingerprints, licenses and mixing."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkrecon.llm import crf, licenses, mixing, order_minhash, packing, pii, rules, token_counts
from tests.llm import brute

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "é", "▁", "\xa0", "Wort", "'s", "12", "<s>", "<|endoftext|>", "漢", "🙂", ".", "\x00", "\x85", "²"]


def fuzz(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return brute.frame(spark, brute.ODD)


def test_counts_of_rules(spark, odd):
    got = rules.host_rules(odd)
    rows = sorted(map(repr, (tuple(r)[:6] for r in got.collect())))
    assert rows == sorted(repr((d, *brute.text_counts(t))) for d, t, _ in brute.ODD)
    assert rules.host_rules(odd.limit(0)).count() == 0


def test_host_with_failures_is_rejected(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(80)), f"h{i % 20}") for i in range(400)]
    bad = [(1000 + i, "# # # " + " ".join(f"v{i}x{j}#" for j in range(80)), "bad") for i in range(60)]
    small = [(2000, "# # # " + " ".join(f"u{j}#" for j in range(80)), "small")]
    got = rules.host_rules(brute.frame(spark, good + bad + small)).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(400)) and not any(kept[1000 + i] for i in range(60))
    assert kept[2000]  # one document is not enough evidence against a host
    assert not any(r["base_failed"] for r in got)


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    offsets, edge = np.array([0, 4, 5, 8]), rng.normal(size=(2, 2))
    node = rng.normal(size=8)
    p, pairs = crf.marginals(node, offsets, edge)
    want, want_pairs = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(offsets, offsets[1:]):
        weights = {}
        for y in product((0, 1), repeat=b - a):
            s = sum(node[a + i] * v for i, v in enumerate(y)) + sum(edge[u, v] for u, v in zip(y, y[1:]))
            weights[y] = np.exp(s)
        total = sum(weights.values())
        for y, w in weights.items():
            want[a:b] += np.array(y) * w / total
            for u, v in zip(y, y[1:]):
                want_pairs[u, v] += w / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_classifier_held_out(spark):
    """Trained on four fifths of the labels, judged on the rest."""
    from sparkrecon.llm.queries import op2_quality_crf

    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = op2_quality_crf(spark, folder).filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95


def test_classifier_on_odd_texts(spark, odd):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, None), (9, 0), (9, 0)], "doc_id long, quality int")
    model = crf.train(odd, labels)
    rows = crf.score(odd, model).collect()
    assert len(rows) == len(brute.ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert crf.good_documents(odd, model, -1.0).count() == len(brute.ODD)
    assert crf.good_documents(odd, model).columns == odd.columns
    assert crf.train(odd, labels.limit(0)) is None
    assert {r["score"] for r in crf.score(odd, None).collect()} == {0.5}
    assert crf.score(odd.limit(0), model).count() == 0


def test_token_lengths_are_the_librarys():
    lengths, library = token_counts.Lengths({}, PIECES), token_counts.processor(PIECES)
    for text in [*fuzz(1, 3000), *(t or "" for _, t, _ in brute.ODD)]:
        assert token_counts.text_length(text, lengths) == len(library.encode(text)), repr(text)


def test_token_counts(spark, odd):
    got = sorted(map(repr, map(tuple, token_counts.token_counts(odd, PIECES).collect())))
    library = token_counts.processor(PIECES)
    n = [len(library.encode(t or "")) for _, t, _ in brute.ODD]
    want = [(d, len((t or "").encode()), k, k > 4096) for (d, t, _), k in zip(brute.ODD, n)]
    assert got == sorted(map(repr, want))
    assert token_counts.token_counts(odd.limit(0), PIECES).count() == 0


def test_ids_are_the_librarys():
    texts = [*fuzz(2, 3000), *(t or "" for _, t, _ in brute.ODD)]
    library = packing.tokenizer(BYTES)
    for text, ids in zip(texts, packing.Ids(BYTES).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark, odd):
    rows = packing.packed_documents(odd, BYTES).collect()
    library = packing.tokenizer(BYTES)
    pieces = []
    for doc, text, _ in brute.ODD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, pieces))
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed_documents(odd.limit(0), BYTES).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins, offsets = packing.best_fit([6, 5, 3, 4], 10, 8)
    assert bins == [0, 1, 0, 1] and offsets == [0, 0, 6, 5]
    bins, _ = packing.best_fit([6, 7, 8, 3, 4], 10, 2)  # 8 closes the bin with 7, so 3 fits in none but 6's
    assert bins == [0, 1, 2, 0, 3]
    rng = random.Random(6)
    lengths = [rng.randint(1, 1023) for _ in range(20000)]
    assert max(packing.best_fit(lengths, 1024, packing.OPEN_BINS)[0]) < 1.03 * sum(lengths) / 1024


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(7)
    for _ in range(20000):
        alphabet = rng.choice([list("ab_.@-%+é "), list("0123.45 -+()x"), ["4111111111111111", " ", "-", "+1", "1.2.3.4", "a@b.co", "x", "."]])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute.base_spans(text), text
    for text in ("9" * 50000, "@" * 50000, "a" * 50000 + "@", "1." * 50000, "+1" * 50000, "+1" + " " * 50000):
        pii.base_spans(text)  # linear


def test_personal_data(spark, odd):
    secret = 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"'
    rows = [(200 + i, f"x{i} {secret} me.{i}@mail.example.com", "s") for i in range(40)]
    rows += [(100, "sha 1eb9c654e721b4f812088970e66a6345cee33dd6", "s"), *brute.ODD]
    docs = brute.frame(spark, rows)
    got = {(r["doc_id"], r["n_email"], r["spans"]) for r in pii.find_personal_data(docs).collect()}
    for i in range(40):
        a = len(f"x{i} ") + 9
        b = a + 40
        assert (200 + i, 1, f"email:{b + 2}:{b + 2 + len(f'me.{i}@mail.example.com')},secret:{a}:{b}") in got
    assert (100, 0, "") in got
    base = {r["base_sha256"] for r in pii.find_personal_data(odd).collect()}
    assert base == {hashlib.sha256(b"").hexdigest()}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.filter("doc_id = 201").first()["text"] == 'x1 token = "<SECRET>" <EMAIL>'
    assert clean.filter("doc_id = 3").first()["text"] is None
    assert pii.find_personal_data(odd.limit(0)).count() == 0 and pii.redact(odd.limit(0)).count() == 0


def test_order_minhash(spark, odd):
    rows = sorted(brute.ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (doc, text, _) in enumerate(rows):
        changed = order_minhash.edited(text or "", rows[(i + 1) % len(rows)][1] or "")
        own, other = order_minhash.sketch(text or ""), order_minhash.sketch(changed)
        following = order_minhash.sketch(rows[(i + 1) % len(rows)][1] or "")
        digest = hashlib.sha256(changed.encode()).hexdigest()
        like = order_minhash.likeness
        want.append((doc, len(text or ""), digest, own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), like(own, other), like(own, following)))
    got = order_minhash.edited_neighbours(odd).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert order_minhash.edited_neighbours(odd.limit(0)).count() == 0
    assert order_minhash.fingerprints(odd).filter("doc_id = 1").distinct().count() == 1


def test_order_minhash_sees_order():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(4000))
    swapped = text[2000:] + text[:2000]  # the same k-mers but for the seam
    one_edit = text[:1000] + "z" + text[1001:]
    near = lambda a, b: order_minhash.likeness(order_minhash.sketch(a), order_minhash.sketch(b))
    assert near(text, one_edit) > 0.9 > near(text, swapped) > 0 and near(text, text) == 1


@pytest.mark.parametrize("length", [1020, 4090])
def test_order_minhash_of_near_copies_across_powers_of_two(length):
    rng = random.Random(9)
    near = []
    for _ in range(20):
        words = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(length))
        text, longer = words[:length], words[: length + 40]
        assert (length - order_minhash.K + 1).bit_length() < (length + 40 - order_minhash.K + 1).bit_length()
        near.append(order_minhash.likeness(order_minhash.sketch(text), order_minhash.sketch(longer)))
    assert min(near) > 0.6 and np.mean(near) > 0.85, near


def test_order_minhash_numbers_equal_kmers_in_text_order():
    text = "".join(random.Random(10).choice("ab") for _ in range(300))
    value, kmer, place = order_minhash.numbered_kmers(text)
    seen, number, hashes = {}, {}, {}
    for i in range(len(text) - order_minhash.K + 1):
        k = text[i : i + order_minhash.K]
        number[i] = seen[k] = seen.get(k, -1) + 1
    for v, h, i in zip(value.tolist(), kmer.tolist(), place.tolist()):
        k = text[i : i + order_minhash.K]
        assert hashes.setdefault(k, h) == h
        assert hashes.setdefault((k, number[i]), v) == v
    assert len(place) == len(set(place.tolist())) == len(number) and len(set(value.tolist())) == len(value)


def test_order_minhash_tells_kmers_apart_whose_upper_bits_agree(monkeypatch):
    monkeypatch.setattr(order_minhash, "mix", lambda x: x & np.uint64(0xF))
    _, cut, place = order_minhash.numbered_kmers("abcdefghijklmnopqrst" * 2)
    whole = [h for _, h in sorted(zip(place.tolist(), cut.tolist()))]
    assert len(set(whole)) > 1 and whole[:15] == whole[20:35]


def test_licenses(spark, odd):
    rows = [
        (1, "Under the MIT License. under the mit-license x cc by nc cc-by-nc Apache License, Version 2.0", "s"),
        (2, "Licensed under the GNU General Public License, version 3, or the GNU General Public License", "s"),
        (3, "x SPDX-License-Identifier: MIT License é. All rights reserved", "s"),
        (4, "cc by nc " * 500, "s"),
    ]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_scan(brute.frame(spark, rows)).collect()}
    assert got[1] == (20, 5, 0, 15, "apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,mit", 0.7)
    assert got[2] == (15, 0, None, None, "", "gpl,gpl-3", 0.8)
    assert got[3] == (10, 0, None, None, "", "all-rights-reserved,mit", 0.9)
    assert got[4][:5] == (1500, 500, 0, 1497, "cc-by-nc")
    rows = licenses.license_scan(odd).collect()
    assert len(rows) == len(brute.ODD) and {r["labels"] for r in rows} == {""}
    assert [r["n_words"] for r in rows if r["doc_id"] == 3] == [0]
    assert licenses.license_scan(odd.limit(0)).count() == 0


def _phrases(words: str) -> list[str]:
    """Every text a rule's words stand for."""
    found = [""]
    for word in words.split(" "):
        optional = word.startswith("[") and word.endswith("]")
        bare = word[1:-1] if optional else word
        choices = bare.strip("()").split("|") if bare.startswith("(") else [bare]
        spelled = [c.replace("_", " ").replace("[cs]", x) for c in choices for x in ("c", "s")[: 1 + ("[cs]" in c)]]
        found = [f"{f} {c}".strip() for f in found for c in ([*spelled, ""] if optional else spelled)]
    return found


def test_every_alternative_of_a_license_rule_passes_its_gates():
    families = licenses.FAMILIES + [(label, f"{s} {t}", k) for s, k in licenses.CC_STEMS for label, t in licenses.CC_TERMS]
    worded = [(label, phrase) for phrase, label in licenses.BASE]
    worded += [(label, " ".join(filter(None, (b, name, a)))) for label, name, _ in families for b, a, _ in licenses.FORMS]
    worded += [(label, words) for label, words, _, _ in licenses.NOTICES]
    stems, rules = licenses.gate_stems(), licenses.rules()
    assert [r[1] for r in rules] == [label for label, _ in worded]
    missed = set()
    for (_, label, keyword, pattern, _), (_, words) in zip(rules, worded):
        for phrase in _phrases(words):
            text = "".join(f" {w} " for w in phrase.split(" "))
            assert re.fullmatch(pattern, text), (pattern, text)
            if keyword not in text or not any(s in text for s in stems):
                missed.add((label, phrase))
    assert not missed, sorted(missed)[:5]


def test_licenses_by_their_other_names(spark):
    rows = [
        (1, "Released under the Expat license", "s"),
        (2, "the FreeBSD 2-clause license", "s"),
        (3, "FreeBSD 2 clause", "s"),
        (4, "distributed under the terms of the FreeBSD 2-clause", "s"),
        (5, "SPDX-License-Identifier: Expat Licence", "s"),
        (6, "FreeBSD is not expat", "s"),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(brute.frame(spark, rows)).collect()}
    assert got == {
        1: ("mit", 0.8), 2: ("bsd-2-clause", 0.6), 3: ("bsd-2-clause", 0.6), 4: ("bsd-2-clause", 0.8), 5: ("mit", 0.9), 6: ("", 0.0)
    }


def test_cube_keeps_the_constraints():
    rng = random.Random(9)
    sizes = [rng.randint(1, 500) for _ in range(400)]
    chance = [0.37] * 400
    p = mixing.flight(sizes, chance, random.Random(1))
    assert sum(0 < x < 1 for x in p) <= 2 and all(0 <= x <= 1 for x in p)
    assert abs(sum(p) - 148) < 1e-5
    assert abs(sum(s * x for s, x in zip(sizes, p)) - 0.37 * sum(sizes)) < 1e-3
    assert set(mixing.landing(sizes, p, random.Random(2))) <= {0.0, 1.0}


@pytest.mark.parametrize("seed", range(10))
def test_a_large_document_settles_before_small_ones(seed):
    rng = random.Random(seed)
    sizes = [20_000] + [rng.randint(50, 450) for _ in range(600)]
    p = mixing.flight(sizes, [0.35] * 601, random.Random(seed))
    end = mixing.landing(sizes, p, random.Random(seed))
    assert abs(sum(s * x for s, x in zip(sizes, end)) - 0.35 * sum(sizes)) < 250


def test_flight_is_fair():
    sizes = [900, 40, 40, 10, 300, 5, 0, 70]
    took = [mixing.flight(sizes, [0.4] * 8, random.Random(seed)) for seed in range(4000)]
    for i in range(8):
        assert abs(sum(p[i] for p in took) / 4000 - 0.4) < 0.04


def test_mix_with_documents_far_above_the_mean(spark):
    rows = [(i, "w " * (20 + i % 30), "abc"[i % 3]) for i in range(900)]
    rows += [(1000 + i, "w " * 5000, "abc"[i % 3]) for i in range(6)]
    got = mixing.mix(brute.frame(spark, rows)).collect()
    for source in "abc":
        rs = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) < 50, source
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_mixed_documents_pass_any_column(spark):
    docs = brute.frame(spark, [(i, "w " * (i + 1), "a") for i in range(30)] + [(3, "w w w w", "a")] * 5)
    for name in ("__k", "__size", "key", "row", "times", "a.b"):
        docs = docs.withColumn(name, F.lit("own"))
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("source")))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.schema["m"].dataType == docs.schema["m"].dataType
    rows = mixed.collect()
    assert len(rows) == mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert all(r["__k"] == r["__size"] == "own" for r in rows)


def test_redact_keeps_the_type_of_n_chars(spark):
    docs = brute.frame(spark, [(1, "write to me@example.org now", "s"), (2, None, "s")])
    want = len(pii.redact(docs).filter("doc_id = 1").first()["text"])
    for kind in ("int", "double", "bigint"):
        got = pii.redact(docs.withColumn("n_chars", F.col("n_chars").cast(kind)))
        assert dict(got.dtypes)["n_chars"] == kind and got.filter("doc_id = 1").first()["n_chars"] == want
    assert pii.redact(docs.withColumn("n_chars", F.lit("own"))).first()["n_chars"] == "own"


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)  # several levels
    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    docs = brute.frame(spark, rows)
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert got and sorted(r["doc_id"] for r in got) == list(range(900))
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"]
        by.setdefault(r["source"], []).append(r)
    want = water_fill({s: sum(r["size"] for r in rs) for s, rs in by.items()}, total)
    for source, rs in by.items():
        assert abs(rs[0]["target"] - want[source]) < 1e-6
        assert abs(sum(r["taken"] for r in rs) - want[source]) <= 60
    again = mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["taken"]) for r in got)
    copies = sum(r["copies"] for r in got)
    assert mixing.mixed_documents(docs).count() == copies
    assert mixing.mixed_documents(docs).columns == docs.columns


def water_fill(sizes: dict, total: float) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(total)
    while open_:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= above
    return target


def test_mix_of_odd_rows(spark, odd):
    assert mixing.mix(odd).count() == len(brute.ODD)
    taken = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(odd).count() == taken
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0


def test_counts_of_personal_data_are_by_kind(spark):
    """The counts belong to the kind, wherever its spans stand in the list."""
    texts = [
        "a@b.co, c@d.org and e@f.net",
        "1.2.3.4 +44 20 7946 0958",
        "4111 1111 1111 1111, 1.1.1.1 255.2.3.4 x@y.z +1 (212) 555-0199 +49 30 123456",
        None,
        "",
        "300.1.1.1 4111 1111 1111 1112",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_personal_data(docs).orderBy("doc_id").collect()
    counts = [(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in found]
    assert counts == [(3, 0, 0, 0), (0, 1, 0, 1), (1, 2, 1, 2), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    for r in found:
        listed = [s for s in r["spans"].split(",") if s.partition(":")[0] in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert len(listed) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
