"""Language ID, licences, personal data and LM scoring: held-out accuracy, brute force and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import langid, licences, lm_scoring, pii
from tessera.llm.queries import QUERIES


def test_language_id_on_held_out_documents(spark, sf, documents):
    found = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, sf).collect()}
    given = {r.doc_id: r.lang for r in documents.collect()}
    assert set(found) == set(given)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [i for i, r in found.items() if r.held_out]
    assert np.mean([found[i].lang_pred == given[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_backoff():
    counts = [("en", 0, "the", 10), ("fr", 0, "les", 10), ("en", 4, "<riv", 5), ("fr", 3, "<vi", 4), ("en", 1, "q", 3), ("fr", 4, "<ést", 5), ("en", 3, "the", 4), ("fr", 1, "ç", 3)]
    m = langid.Model(counts)
    assert m.languages == ["en", "fr"]
    for word, order in (("the", 0), ("river", 4), ("village", 3), ("q", 1)):
        assert np.argmax(m.word(word)) == (0 if order in (0, 4, 1) else 1)
    assert not m.word("zzz").any()
    s = m.scorer()
    assert s.predict(None) == s.predict("") == s.predict("12 ½ !") == (langid.UNKNOWN, 0.0, 0)
    assert s.predict("zzz") == ("en", 0.5, 0)
    assert langid.Model([]).scorer().predict("the") == (langid.UNKNOWN, 0.0, 0)


def test_language_id_of_awkward_rows(awkward, nothing):
    m = langid.train(awkward)
    assert sorted(m.languages) == ["en", "fr"]
    out = {r.doc_id: r.lang_pred for r in langid.identify(awkward.select("doc_id", "text"), m).collect()}
    assert out[3] == out[4] == out[9] == langid.UNKNOWN and out[5] == "fr" and out[1] == "en"
    assert langid.train(nothing).languages == []
    assert langid.identify(nothing, m, prefix="p_").count() == 0


def test_licences():
    texts = licences.known_templates()
    t = licences.Templates(texts, 0.8)
    brute = lambda words: max(((licences.dice(licences.bigrams(words), b), n) for n, b in t.sets), key=lambda x: x[0])
    for name, text in texts.items():
        assert t.best(licences.normalised(text.upper())) == (name, 1.0)
    rng = np.random.default_rng(3)
    vocabulary = sorted({w for x in licences.NOTICES.values() for w in licences.normalised(x)})
    for text in texts.values():
        for share in (0.02, 0.1, 0.2):
            words = [w if rng.random() > share else str(rng.choice(vocabulary)) for w in licences.normalised(text)]
            d, _ = brute(words)
            got = t.best(words)
            assert (got is None) == (d < 0.8) and (got is None or got[1] == d)
    text = "Some prose here.\nReleased under the MIT License.\nMore prose. Licensed under CC BY-NC 4.0. And more"
    assert [(text[a:b], n) for a, b, n, _ in t.scan(text)] == [("Released under the MIT License.", "MIT notice"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0 notice")]


def test_licences_within_a_longer_text():
    texts = licences.known_templates()
    t = licences.Templates(texts, 0.8)
    prose = "The river ran over the stones and the children came down to watch the boats. " * 20
    for name in ("MIT", "Apache-2.0 header", "GPL-3.0 header"):
        words = texts[name].split()
        broken = "\n\n".join(" ".join(words[i : i + len(words) // 3 + 1]) for i in range(0, len(words), len(words) // 3 + 1))
        for text in (f"{prose}\n{broken}\nint main;\n{prose}", f"{prose}{broken} {prose}"):
            assert [h[3] for h in t.scan(text) if h[2] == name] == [1.0]
    wrapped = f"{prose}It is Released under\nthe MIT License. {prose}"
    assert [(wrapped[a:b], n) for a, b, n, _ in t.scan(wrapped)] == [("Released under\nthe MIT License", "MIT notice")]
    assert t.scan(prose) == []


@pytest.mark.parametrize("name", licences.FULL_TEXTS)
def test_whole_licences_alone_and_at_the_head_of_a_file(name):
    text = licences.known_templates()[name]
    t = licences.Templates(licences.known_templates(), 0.8)
    commented = "/*\n" + "".join(f" * {line}\n" for line in text.splitlines()) + " */\nint main(void) { return 0; }\n" * 40
    for whole in (text, f"Copyright (c) 2020 Somebody\n\n{text}\n", commented):
        assert max(h[3] for h in t.scan(whole) if h[2] == name) >= 0.97


def plain_windows(words, b, t):
    """(first, last word, dice) of the best window from each place where one begins, by trying all."""
    out = []
    for i in range(len(words) - 1):
        if (words[i], words[i + 1]) in b:
            tried = [(licences.dice(licences.bigrams(words[i : j + 1]), b), -j) for j in range(i + 1, len(words)) if (words[j - 1], words[j]) in b]
            d, j = max(tried)
            if d >= t:
                out.append((i, -j, d))
    return out


def test_windows_equal_all_windows():
    rng = np.random.default_rng(17)
    for _ in range(150):
        templates = {n: " ".join(rng.choice(list("abcdefgh"), rng.integers(3, 12))) for n in ("x", "y")}
        t = licences.Templates(templates, 0.6)
        words = [str(w) for w in rng.choice(list("abcdefghijk"), rng.integers(2, 50))]
        starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
        for k, (name, b) in enumerate(t.sets):
            got = sorted((starts.index(a), d) for a, _, n, d in t.windows(" ".join(words), [k]) if n == name)
            assert got == [(i, d) for i, _, d in plain_windows(words, b, 0.6)]
            if got:
                assert k in t.candidates(words)


def test_many_licences_in_one_text():
    t = licences.Templates(licences.known_templates(), 0.8)
    for text, n in (("Released under the MIT License.\n" * 5000, 5000), ("Released under the MIT License " * 5000, 5000)):
        assert len(t.scan(text)) >= n * 0.9


def test_licences_of_awkward_rows(awkward, nothing):
    assert all(r.n_matches == 0 and r.licence is None for r in licences.scan_licences(awkward).collect())
    assert licences.scan_licences(awkward).count() == awkward.count() and licences.scan_licences(nothing).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_matching(spark):
    rng = np.random.default_rng(11)
    parts = ["a@b", ".c", "@", "%x", "1", "22", "255", "256", ".", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (523) 555-1055", "+", " ", "-", "é", "😀", "zz", "0007"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(600)] + [None, "", "1" * 3000, "a" * 3000 + "@b.c", "x@y" + ".a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        want = plain_spans(texts[r.doc_id])
        assert [(s.start, s.rank, s.end) for s in r.base_spans] == want, texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))


def disclosure_cases(spark):
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    words = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)]
    rng = np.random.default_rng(5)
    fill = lambda n: " ".join(rng.choice(words, n))
    texts = [f"{fill(12)} Zacharias bob.z@corp.example.com {fill(12)}" for _ in range(6)] + [f"{fill(4)} Zacharias {fill(9)}"] + [fill(30) for _ in range(300)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_terms_that_reveal_an_entity_are_spans(spark):
    texts, df = disclosure_cases(spark)
    found = {r.doc_id: r for r in pii.personal_data(df).collect()}
    n, df_e, df_te, df_t = len(texts), 6, 6, 7
    disclosure = math.log2(n * df_te / df_e / df_t) / math.log2(n / df_e)
    assert disclosure >= pii.DISCLOSURE
    at = texts[6].index("Zacharias")
    assert [(s.start, s.end, s.value) for s in found[6].spans] == [(at, at + 9, "generalise" if disclosure < pii.REMOVAL else "remove")]
    assert all(not found[i].spans for i in range(7, n))
    assert all({s.rank for s in found[i].spans} == {0, 5} for i in range(6))


@pytest.mark.parametrize(("n", "df_e", "df_t", "action"), [(305, 5, 7, "generalise"), (330, 30, 31, "remove")])
def test_thresholds_of_disclosure(spark, n, df_e, df_t, action):
    rng = np.random.default_rng(9)
    words = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)]
    texts = [" ".join([*rng.choice(words, 9), *(["Zacharias"] if i < df_t else []), *(["bob.z@corp.example.com"] if i < df_e else []), *rng.choice(words, 9)]) for i in range(n)]
    assert (0.9, 0.98)[action == "remove"] <= math.log2(n / df_t) / math.log2(n / df_e) < (0.95, 0.99)[action == "remove"]
    spans = [s.value for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() for s in r.spans if s.rank == 5]
    assert spans == [action] * df_t


def test_sanitised_texts(spark):
    texts, df = disclosure_cases(spark)
    out = {r.doc_id: r.text for r in pii.sanitised(df.selectExpr("doc_id", "text", "'k' AS key", "1 AS spans")).collect()}
    assert out[0] == texts[0].replace("bob.z@corp.example.com", "[EMAIL]").replace("Zacharias", "[TERM]") and out[100] == texts[100]


def test_personal_data_of_awkward_rows(awkward, nothing):
    out = pii.personal_data(awkward).collect()
    assert len(out) == awkward.count() and [r.n_email for r in out if r.doc_id == 12] == [1]
    assert sum(len(r.spans) for r in out) == 1 + sum(r.n_ip + r.n_card + r.n_phone for r in out)
    assert pii.personal_data(nothing).count() == 0 and pii.sanitised(nothing).count() == 0
    assert pii.sanitised(awkward).columns == awkward.columns and pii.sanitised(awkward).where("doc_id = 3").first().text is None


def sketch(terms):
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    return tuple(min((signed(xxhash.xxh64_intdigest(t + more, seed=42)) for t in terms), default=None) for more in ("", "#"))


def plain_disclosing(texts, matched):
    """Terms of the highest disclosure over all pairs, counted plainly: term -> action."""
    terms = [set(re.findall(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], " ", t.lower()))) for t in texts]
    raw = [set(re.findall(r"[^\W\d_]{3,}", t.lower())) for t in texts]
    n, best = len(texts), {}
    for e in set().union(*matched):
        docs = [i for i, m in enumerate(matched) if e in m]
        for t in set().union(*(terms[i] for i in docs)):
            both = [i for i in docs if t in terms[i]]
            df_t = sum(t in r for r in raw)
            if len({sketch(terms[i]) for i in both}) >= pii.EVIDENCE and n > len(docs):
                d = math.log2(n * len(both) / df_t / len(docs)) / math.log2(n / len(docs))
                best[t] = max(best.get(t, d), d)
    return {t: "remove" if d >= pii.REMOVAL else "generalise" for t, d in best.items() if d >= pii.DISCLOSURE}


def test_disclosing_terms_equal_plain_counts(spark):
    rng = np.random.default_rng(23)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    weights = 1 / np.arange(1, len(words) + 1)
    values = [f"p{i}@mail{i % 3}.org" for i in range(12)]
    texts, matched = [], []
    for _ in range(160):
        own = [str(v) for v in rng.choice(values, rng.integers(0, 3), p=np.array([6, 5, 4, 3, 3, 2, 2, 2, 1, 1, 1, 1]) / 31)]
        names = [f"name{chr(97 + values.index(v))}" for v in own if rng.random() < 0.9]
        # A word of its own keeps the sketches of different texts apart.
        texts.append(" ".join([*rng.choice(words, 8, p=weights / weights.sum()), *names, *own, "".join(rng.choice(list("abcdefghij"), 9))]))
        matched.append(set(own))
    want = plain_disclosing(texts, matched)
    found = {}
    for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert r.n_term == sum(s.rank == 5 for s in r.spans)
        found |= {texts[r.doc_id][s.start : s.end].lower(): s.value for s in r.spans if s.rank == 5}
    covered = {w for v in values for w in re.findall(r"[^\W\d_]{3,}", v)}
    assert len(want) > 5 and found == {t: a for t, a in want.items() if t not in covered}


def test_secrets_and_many_spans(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    many = " ".join(f"a{i}@mail.example.org and {secret[:30]}{i:06d} so" for i in range(25_000))
    rows = [(1, f'token = "{secret}" here'), (2, "averyveryverylongwordwithoutdigits 12345678901234567890"), (3, many)]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.rank, s.value) for s in out[1].spans] == [(4, secret)] and not out[2].spans
    assert out[3].n_email == out[3].n_secret == 25_000 and all(many[s.start : s.end] == s.value for s in out[3].spans[::997])
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[1] == 'token = "[SECRET]" here' and clean[3] == " ".join(["[EMAIL] and [SECRET] so"] * 25_000)


def test_empty_span_digest(spark, sf):
    r = QUERIES["op4_pii"](spark, sf).where("n_email + n_ip + n_card + n_phone = 0").first()
    assert r.base_sha256 == hashlib.sha256(b"").hexdigest()


def plain_losses(texts, good):
    """Plain bigram models of all words, without matrices, chunks or parts."""
    runs = [[None, *lm_scoring.tokens(t)] for t in texts]
    pairs, words, before = ([Counter(), Counter()] for _ in range(3))
    for run, g in zip(runs, good, strict=True):
        for m in (0, 1) if g else (1,):
            pairs[m].update(zip(run, run[1:], strict=False))
            words[m].update(run[1:])
            before[m].update(run[:-1])
    factors = (1, words[0].total() / words[1].total())
    total, size, mass = words[0].total(), len(words[1]) + 2, lm_scoring.MASS
    loss = lambda m, v, w: -math.log((factors[m] * pairs[m][v, w] + mass * (factors[m] * words[m][w] + 0.5) / (total + 0.5 * size)) / (factors[m] * before[m][v] + mass))
    return [[sum(loss(m, v, w) for v, w in zip(run, run[1:], strict=False)) / (len(run) - 1) if len(run) > 1 else None for m in (0, 1)] for run in runs]


def test_lm_scores_equal_plain_models(spark, sf, documents):
    docs = documents.orderBy("doc_id").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    want = plain_losses([r.text for r in docs], [r.doc_id in good for r in docs])
    found = {r.doc_id: r for r in lm_scoring.score(documents, *lm_scoring.train(documents, spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id"))).collect()}
    shown = {r.doc_id: r.score for r in QUERIES["op5_lm_scoring"](spark, sf).collect()}
    assert shown == {i: None if r.score is None else pytest.approx(r.score, abs=1e-6) for i, r in found.items()}
    for d, (t, b) in zip(docs, want, strict=True):
        r = found[d.doc_id]
        assert r.target_loss == pytest.approx(t, abs=1e-9) and r.background_loss == pytest.approx(b, abs=1e-9) and r.score == pytest.approx(t - b, abs=1e-9)


def test_lm_scores_tell_rare_words_apart(spark, awkward, monkeypatch):
    monkeypatch.setattr(lm_scoring, "COMMON", 6)
    monkeypatch.setattr(lm_scoring, "MERGED", 2)
    rows = awkward.select("doc_id", "text").collect()
    losses = plain_losses([r.text for r in rows], [r.doc_id in (1, 7, 12) for r in rows])
    want = sorted((r.doc_id or 0, *x) for r, x in zip(rows, losses, strict=True) if x[0] is not None)
    good = spark.createDataFrame([(1,), (7,), (12,)], "doc_id long")
    out = lm_scoring.score(awkward, *lm_scoring.train(awkward, good)).collect()
    found = sorted((r.doc_id or 0, r.target_loss, r.background_loss) for r in out if r.n_tokens)
    assert len(out) == len(rows) and [f[0] for f in found] == [w[0] for w in want]
    assert np.allclose(found, want, atol=1e-9)


def test_lm_scores_of_awkward_rows(spark, awkward, nothing):
    good = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    out = {r.doc_id: r for r in lm_scoring.score(awkward, *lm_scoring.train(awkward, good)).collect()}
    assert out[3].n_tokens == 0 and out[3].score is None and out[1].score < 0
    none = lm_scoring.train(awkward, good.where("false"))
    assert all(r.score in (None, 0.0) for r in lm_scoring.score(awkward, *none).collect())
    assert lm_scoring.score(nothing, *lm_scoring.train(nothing, good)).count() == 0
