"""Operators that judge each text on its own, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.llm import bpe, exact_dedup, importance, language_model, license_scan, near_dedup, packing, pii, quality_rules, queries, url_filter
from skyloom.llm.queries import tokenizer_file

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def library(name):
    t = tokenizers.Tokenizer.from_file(tokenizer_file(name))
    t.no_truncation()
    t.no_padding()
    return t


# ---- BPE


def test_bpe_equals_the_library(documents, odd_docs):
    path, lib = tokenizer_file("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    for docs in (documents, odd_docs):
        texts = sorted((r["text"] or "") for r in docs.select("text").collect())
        coded = bpe.decode_documents(bpe.encode_documents(docs, path), path).collect()
        assert sorted((tuple(r["ids"]), r["decoded"]) for r in coded) == sorted(
            (tuple(e.ids), lib.decode(e.ids, skip_special_tokens=False)) for e in lib.encode_batch(texts, add_special_tokens=False)
        )


def test_bpe_word_breaks_equal_the_library():
    """Every code point, beside letters, digits, signs, spaces and itself."""
    mine, lib = bpe.load_bpe(tokenizer_file("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = [f"a{c}b {c} 1\n1{c}2,{c}{c};\t{c}\u9c72" for c in map(chr, points[at : at + 20_000])]
        for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
            assert mine.encode(text) == e.ids, ascii(text)


@given(st.text(max_size=40))
@settings(max_examples=500, deadline=None)
def test_bpe_ids_of_any_text(text):
    mine, lib = bpe.load_bpe(tokenizer_file("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    ids = lib.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids and mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@given(st.binary(min_size=1, max_size=200), st.sampled_from([b"", b"the", b" and", b"aaaa"]))
@settings(max_examples=200, deadline=None)
def test_bpe_heap_and_scan_agree(raw, more):
    mine = bpe.load_bpe(tokenizer_file("byte_bpe_50k.json"))
    word = (raw + more) * 2
    assert mine.merge_short(word) == mine.merge_long(word)


def test_bpe_empty_table(no_docs):
    assert bpe.encode_documents(no_docs, tokenizer_file("byte_bpe_50k.json")).count() == 0


# ---- packing


def test_word_ids_equal_the_library(texts):
    mine, lib = packing.WordIds(tokenizer_file("word_bpe_49k.json")), library("word_bpe_49k.json")
    odd = ["don't <|endoftext|>x\u00a0Y \u0130 \u03a3\u03a3 e\u0301 \u0301 a", "", " ", "ÀÉ\u2003ß1234"]
    odd += [f"A{chr(c)}b {chr(c)} 1'S" for c in [*range(1, 0x3000), *range(0xFE00, 0xFFF0)]]
    some = [*texts.values()] + odd
    for text, e in zip(some, lib.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == e.ids, ascii(text[:80])


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_packing_is_whole_and_tight(request, which):
    docs, lib = request.getfixturevalue(which), library("word_bpe_49k.json")
    path, capacity = tokenizer_file("word_bpe_49k.json"), 512
    rows = packing.pack_documents(docs, path, capacity=capacity).collect()
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            expected[r["doc_id"], n, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    least = packing.lower_bound(Counter(k[3] for k in expected.elements()), capacity)
    assert len(sequences) <= 1.03 * least + 2


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(counts):
    capacity = 40
    plan = packing.plan_slots(counts, capacity)
    assert Counter({k: v for k, v in counts.items()}) == sum((Counter({p[0]: p[2]}) for p in plan), Counter())
    used: dict[int, int] = {}
    for length, _, n, first, offset in plan:
        for s in range(first, first + n):
            assert used.get(s, 0) == offset
            used[s] = offset + length
    free: list[int] = []  # one document at a time
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [i for i, x in enumerate(free) if x >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(capacity - length)
    assert len(free) == len(used)


def test_packing_empty_table(no_docs):
    assert packing.pack_documents(no_docs, tokenizer_file("word_bpe_49k.json")).count() == 0


# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(texts, odd_docs):
    odd = [r["text"] or "" for r in odd_docs.collect()]
    for text in [*texts.values(), *odd]:
        assert pii.detect(text) == plain_spans(text), text[:200]


@given(st.text("a1.@+ -()4", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_of_any_text(text):
    assert pii.detect(text) == plain_spans(text)


def test_pii_query_against_the_patterns(spark, tmp_path):
    rows = [
        (1, "4111111111111111 word 4111111111111111 word 4111111111111111"), (2, "a@b.co 10.0.0.1 4111 1111 1111 1111 +49 30 1234567"), (3, "10.0.0.1 10.0.0.2"),
        (4, "+49 30 1234567 a@b.co"), (5, "none"), (6, None), (7, "x@y.org " * 40),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op7_pii(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        spans = plain_spans(text or "")
        assert [found[i][f"n_{k}"] for k in BASE] == [sum(x[1] == k for x in spans) for k in range(4)], text
        listed = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in spans)
        assert found[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_revealing_terms_are_spans(spark):
    rows = [(i, f"note {i} word{i} Zarvinson writes from zar@vin.com today number{i} other{i}") for i in range(6)]
    rows += [(100 + i, f"plain{i} today note writes from someone else u{i}@host{i}.org here{i}") for i in range(30)]
    rows += [(200 + i, "copied text with Uniquename near c@opy.net for ever") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i, text in rows[:6]:
        terms = {text[x["start"] : x["end"]] for x in found[i]["spans"] if x["kind"] > 3}
        assert terms == {"Zarvinson"}, terms
    assert all(x["kind"] < 4 for i, _ in rows[6:] for x in found[i]["spans"])  # copies are one context
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise_documents(docs.selectExpr("*", "'en' lang", "'s' source", "1L n_chars")).collect()}
    assert "Zarvinson" not in clean[0] and "zar@vin.com" not in clean[0] and clean[0].startswith("note 0 word0 ")
    assert clean[200] == "copied text with Uniquename near [EMAIL] for ever"


def test_terms_near_an_entity_whatever_their_length():
    words = ["Tellit" + "x" * 60, "y" * 900, *[f"{c}" * 60 for c in "abcde"]]
    text = f"{' '.join(words)} pre10.0.0.1post {' '.join(reversed(words))} 12 34"
    (_, terms), = pii.mentions(text, pii.detect(text))
    assert [t for t, _, _ in terms] == [*[w.lower() for w in words[1:]], "pre", "post", *[w.lower() for w in reversed(words[1:])]]
    assert all(text[s:e].lower() == t for t, s, e in terms)
    joined = ";".join(f"n{k}a@b{k}.org" for k in range(20_000))  # one word full of entities
    found = pii.mentions(joined, pii.detect(joined))
    assert len(found) == 20_000 and max(len(t) for _, t in found) <= 2 * pii.WINDOW_TERMS


def test_sieve_loses_no_key(spark):
    from skyloom.llm import sieve

    keys = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(3000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    for blocks, most in ((1 << 20, 1010), (64, 3000)):
        table = sieve.sieve_of(keys, "key", blocks)
        passed = {r["id"] for r in sieve.sifted(rows, "key", table, blocks).collect()}
        assert set(range(0, 3000, 3)) <= passed and len(passed) <= most
        flags = sieve.marked(rows, "key", table, "maybe", blocks).collect()
        assert {r["id"] for r in flags if r["maybe"]} == passed and len(flags) == 3000


def test_revealing_terms_go_everywhere(spark):
    far = " ".join(f"filler{k}" for k in range(30))
    rows = [(i, f"Bob writes from b{'o' * 3}b@vin.com case{i} {far} and Bob left") for i in range(4)]
    rows += [(50, "later Bob came by"), (60, f"only 王 at one@two.org {far}")]
    rows += [(100 + i, f"{far} writes from case of and left only at later came by plain{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    terms = {i: [text[x["start"] : x["end"]] for x in found[i]["spans"] if x["kind"] > 3] for i, text in rows}
    assert all(terms[i].count("Bob") == 2 for i in range(4))  # short, and far from the address
    assert terms[50] == ["Bob"] and "王" in terms[60]  # without the address; seen in one context only
    assert not any(terms[i] for i, _ in rows if i >= 100)


def test_pii_odd_rows(odd_docs, no_docs):
    assert pii.find_pii(odd_docs).count() == odd_docs.count()
    assert pii.find_pii(no_docs).count() == 0
    out = pii.sanitise_documents(odd_docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == odd_docs.count()
    assert pii.sanitise_documents(no_docs).count() == 0


# ---- quality rules


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(len(re.findall(r"[#*$%&|<>]", w)) for w in words), len(lines) - len(set(lines)), len(repeat))


def test_statistics(texts, odd_docs):
    for text in [*texts.values(), *[r["text"] or "" for r in odd_docs.collect()]]:
        assert quality_rules.statistics_of(text)[:5] == plain_statistics(text)


def test_rules_find_bad_and_keep_good(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.quality_rules(documents, labels).join(labels, "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert n.get((0, False), 0) >= 0.6 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_verdict_is_one_ordered_expression(spark):
    rows = spark.createDataFrame([(False, 1.0, 5.0), (False, 3.0, 5.0), (True, 3.0, 5.0)], "base_failed boolean, symbol_ratio double, mean_word double")
    rule = [[("symbol_ratio", "<=", 2.0), ("mean_word", ">", 4.0)]]
    assert [r[0] for r in rows.select(quality_rules.verdict(rule)).collect()] == [False, True, False]


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(odd_docs, labels).count() == odd_docs.count()
    assert quality_rules.keep_good(no_docs, labels.limit(0)).count() == 0
    assert quality_rules.keep_good(odd_docs, labels).columns == ["doc_id", "text", "lang", "source", "n_chars"]


# ---- licences


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [p[0] for p in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({p[1] for p in places}))


@pytest.mark.parametrize("which", ["documents", "odd_docs", "no_docs"])
def test_license_base(request, which):
    docs = request.getfixturevalue(which)
    found = license_scan.scan_licenses(docs).collect()
    key = lambda x: tuple(map(str, x))
    mine = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=key)
    assert mine == sorted(((r["doc_id"], *plain_licenses(r["text"] or "")) for r in docs.collect()), key=key)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set([*r["labels"].split(","), ""]) for r in found)


def test_license_texts_get_labels(spark):
    rows = [(i, f"intro {i} {text.lower().replace('*', str(i))} and so on") for i, (_, text) in enumerate(license_scan.TEXTS)] + [(99, "free use of software in any form")]
    found = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in found[i] for i, (label, _) in enumerate(license_scan.TEXTS)), found
    assert found[99] == [""]


def test_license_found_beside_a_shifted_anchor(spark):
    # an inserted word moves the rarest words, the mandatory ones stand where they should
    text = "Permission to use, copy, modify, and/or distribute this software for any really purpose with or without fee is hereby granted"
    others = [(i, "permission is hereby granted to use copy modify this software with the fee") for i in range(1, 9)]
    found = license_scan.scan_licenses(spark.createDataFrame([(0, text), *others], "doc_id long, text string"), min_coverage=0.3).where("doc_id = 0").first()
    assert found["labels"] == "isc"


# ---- URLs


def test_urls(spark):
    urls = ["https://A.Example.net/en/x?y#z", "http://example.net/de/", "http://net/", "http://net", "x", None, "", "http://notnet/", "http://a.org/fr/", "http://example.com/de/1",
            "http://sub.example.com/de", "http://example.net:80/en/", "http://e.net//en/", "a://b://c.net/", "http://x.net/?a=/", "http://x.org?/fr/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*urls, urls[0], urls[0]])], "page_id long, url string, host string, rule string")
    rules = [(v, *r.split("/", 1)) for v, r in url_filter.RULES]

    def judge(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fit = [(len(h + p), f"{h}/{p}", v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()}
    assert found == {i: judge(u) for i, u in enumerate([*urls, urls[0], urls[0]])}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_long_urls_and_any_rules(spark):
    urls = ["http://x.net" + "/a" * 50_000, "http://" + "a." * 20_000 + "net/q", "http://a.org/up/down", "http://a.org/upper", "http://b.org", "http://a.org/" + "u" * 100_000]
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[2]), (None, urls[2])], "page_id long, url string")
    rules = url_filter.rule_table(spark, (("block", "net/"), ("block", "a.org/up"), ("allow", "a.org/up/"), ("block", "b.org")))
    found = [(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()]
    want = [(0, "net/", "block"), (1, "net/", "block"), (2, "a.org/up/", "allow"), (3, "a.org/up", "block"), (4, "b.org", "block"), (5, None, "allow")]
    assert Counter(found) == Counter([*want, (None, "a.org/up/", "allow"), (None, "a.org/up/", "allow")])
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_words_match_regex_module():
    assert bpe.WORDS.findall("I'm  here") == ["I", "'m", " ", " here"] and regex and F


# ---- very long texts, and ids beyond what a double holds


def long_texts():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in rng.integers(0, 5000, 150_000)]
    return [" ".join(words), "ab" * 60_000, "line of words\n" * 60_000, "1 " * 100_000 + "x@y.z"]


def test_very_long_texts_are_read_whole():
    bpe_mine, bpe_lib = bpe.load_bpe(tokenizer_file("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    words_mine, words_lib = packing.WordIds(tokenizer_file("word_bpe_49k.json")), library("word_bpe_49k.json")
    for text in long_texts():
        assert quality_rules.statistics_of(text)[:5] == plain_statistics(text)
        assert pii.detect(text) == plain_spans(text)
        assert bpe_mine.encode(text) == bpe_lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words_mine.encode(text), "<u4").tolist() == words_lib.encode(text, add_special_tokens=False).ids
        n = len(text.split())
        assert len(near_dedup.shingle_set(text)) <= max(1, n - 4) and len(importance.features(text)) == 2 * n - 1


def test_ids_beyond_doubles_beside_nulls(spark):
    ids = [2**53 + 1, None, 2**53 + 3, -(2**60) - 1]
    rows = [(i, t, "en", "s", 5) for i, t in zip(ids, ["alpha beta gamma delta epsilon", "mail a@b.cd now", None, "MIT license text here"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(ids[0], 1, 0), (ids[3], 0, 0)], "doc_id long, quality int, toxic int")
    pages = docs.selectExpr("doc_id AS page_id", "concat('http://a.net/', text) AS url")
    words, tokens = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
    found = {
        1: exact_dedup.exact_dedup(docs), 2: language_model.lm_scores(docs), 3: license_scan.scan_licenses(docs), 4: url_filter.judge_urls(pages, url_filter.rule_table(spark)), 5: near_dedup.near_duplicates(docs),
        6: packing.pack_documents(docs, words), 7: pii.find_pii(docs), 8: importance.resample(docs, labels), 9: quality_rules.quality_rules(docs, labels), 10: bpe.decode_documents(bpe.encode_documents(docs, tokens), tokens),
    }
    for n, rows in found.items():
        assert {r[0] for r in rows.select("page_id" if n == 4 else "doc_id").collect()} == set(ids), n
    assert {r["doc_id"] for r in pii.sanitise_documents(docs).collect()} == set(ids)


def test_importance_is_the_models_ratio(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40 if i % 2 else 80, 30)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int")
    target = {i for i in range(0, 60, 3) if i % 2}
    bags = [Counter(importance.features(t).tolist()) for t in texts]
    n_raw, n_target = sum(bags, Counter()), sum((bags[i] for i in target), Counter())
    for r in importance.resample(docs, labels).collect():
        own, mine = bags[r["doc_id"]], r["doc_id"] in target
        size = sum(own.values())
        raw_all, target_all = sum(n_raw.values()) - size, sum(n_target.values()) - size * mine
        want = sum(c * (np.log((n_target[f] - c * mine + 1) / (target_all + importance.FEATURES)) - np.log((n_raw[f] - c + 1) / (raw_all + importance.FEATURES))) for f, c in own.items())
        assert r["n_features"] == size and abs(r["log_ratio"] - want) < 1e-6
    assert importance.resample(docs, labels, keep_share=1.0).where("kept").count() == 60
