"""Terms that disclose personal data: where they are sanitised, and on how much evidence."""

import hashlib
import math
import random
import re

from plain_pii import plain_spans

from cohortloom.llm import pii

FILLER = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "po", "ki", "du")]


def prose(rng, n=20):
    return " ".join(rng.choice(FILLER) for _ in range(n))


def test_terms_are_sanitised_far_from_the_mention(spark):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng)} write to zanthorius at jo@x.org {prose(rng, 60)} Zanthorius {prose(rng)}") for i in range(8)]
    rows += [(100 + i, prose(rng)) for i in range(200)] + [(500, f"{prose(rng, 40)}, \U0001f600 zanthorius; {prose(rng)} zanthoriusx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    for i, text in [*rows[:8], rows[-1]]:
        at = text.lower().find("zanthorius")
        places = set()
        while at >= 0:
            if not text[at + 10 : at + 11].isalpha():
                places.add((at, at + 10))
            at = text.lower().find("zanthorius", at + 1)
        assert places <= {(s.start, s.end) for s in found[i] if s.kind == 4 and s.action == "remove"}
        assert all(text[s.start : s.end].lower() == s.value for s in found[i] if s.kind == 4)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("zanthorius" in t.lower().split() for t in clean.values())
    assert clean[500] == rows[-1][1].replace("zanthorius;", "[REMOVED];") and clean[100] == rows[8][1]


def test_data_that_occurs_once_has_terms(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30)) for i in range(300)]
    rows += [(900, f"{prose(rng)} quorvex at once@x.org {prose(rng)}"), (901, f"{prose(rng)} call +1 (784) 555-8120 {prose(rng)}")]
    rows += [(1000 + i, f"{prose(rng)} call back {prose(rng)}") for i in range(9)]
    found = {r.doc_id: r.spans for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {i: {s.value for s in found[i] if s.kind == 4} for i in found}
    # The hapax beside the only mention discloses it; a word of ten texts and common words do not.
    assert terms[900] == {"quorvex"} and terms[901] == set()
    assert not any(terms[i] for i in terms if i != 900)


def test_little_evidence_is_no_disclosure(spark):
    docs = spark.createDataFrame([(1, "write to zanthorius at jo@x.org"), (2, "other words"), (3, "more text")], "doc_id long, text string")
    assert not any(s.kind == 4 for r in pii.find_spans(docs).collect() for s in r.spans)


def plain_actions(rows, remove=pii.REMOVE, generalise=pii.GENERALISE, chance=pii.CHANCE):
    """Terms and what is done to them, by plain counting over (doc_id, text)."""
    n, words, met, windows, holders = len(rows), {}, {}, {}, {}
    for at, (_, text) in enumerate(rows):
        text = text or ""
        for w in {w.lower() for w in re.findall(r"[^\W\d_]+", text)}:
            words.setdefault(w, set()).add(at)
        for start, _, kind, end in plain_spans(text):
            entity = f"{kind}:{hashlib.sha256(text[start:end].lower().encode()).hexdigest()}"
            holders.setdefault(entity, set()).add(at)
            before, after = text[max(0, start - pii.WINDOW) : start], text[end : end + pii.WINDOW]
            left = re.sub(r"^[^\W\d_]+", "", before) if len(before) == pii.WINDOW else before
            right = re.sub(r"[^\W\d_]+$", "", after) if len(after) == pii.WINDOW else after
            for w in {w.lower() for part in (left, right) for w in re.findall(r"[^\W\d_]+", part) if len(w) >= pii.SHORTEST}:
                met.setdefault((entity, w), set()).add(at)
                windows.setdefault((entity, w), set()).add((before, after))
    best = {}
    for (entity, w), docs in met.items():
        n_c, n_t, n_ct = len(holders[entity]), len(words[w]), len(docs)
        k = min(len(windows[entity, w]), n_ct)
        likely = k * math.log(n_c * n_t / n) - (0 if k == 1 else k * math.log(k) - k)
        if n_c < n and likely <= math.log(chance):
            best[w] = max(best.get(w, (0, "")), (math.log(n_ct * n / (n_c * n_t)) / math.log(n / n_c), entity))
    return {w: "remove" if d >= remove else entity.split(":")[0] for w, (d, entity) in best.items() if d >= generalise}


def corpus():
    rng = random.Random(8)
    rows = [(i, prose(rng, 25)) for i in range(240)]
    # Meets its address in three windows of one document, and stands in two others without it.
    rows += [(300, " ".join(f"telvarin at tel@x.org {prose(rng, 14)}" for _ in range(3))), (301, f"telvarin {prose(rng)}"), (302, f"telvarin {prose(rng)} {prose(rng)}")]
    rows += [(400 + i, f"{prose(rng)} mirabold calls +1 (784) 555-8120 {prose(rng)}") for i in range(9)] + [(450, f"{prose(rng)} mirabold")]
    rows += [(500, f"{prose(rng)} quorvex by once@x.org {prose(rng, 40)} Quorvex"), (500, f"{prose(rng)} quorvex"), (501, None), (502, ""), (None, f"zelkin 10.1.2.3 {prose(rng)}")]
    return [*rows, rows[0], rows[1], rows[-1]]


def test_terms_are_those_of_plain_counting(spark):
    rows = corpus()
    actions = plain_actions(rows)
    assert {"remove", "email"} <= set(actions.values()) and "telvarin" not in actions
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, [(s.start, s.end, s.kind, s.action) for s in r.spans]) for r in pii.find_spans(docs).collect())
    want = []
    for i, text in rows:
        own = [(a, e, k, "mask") for a, k, _, e in plain_spans(text)]
        terms = [(m.start(), m.end(), 4, actions[m[0].lower()]) for m in re.finditer(r"[^\W\d_]+", text or "") if m[0].lower() in actions]
        free = [t for t in terms if not any(t[0] < e and a < t[1] for a, e, _, _ in own)]
        want.append((i or -1, sorted(own + free, key=lambda s: (s[0], s[1], s[2]))))
    assert got == sorted(want)


def plain_mask(text, spans):
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{pii.KINDS[s.kind].upper()}]" if s.action == "mask" else "[REMOVED]" if s.action == "remove" else f"[{s.action.upper()} TERM]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def test_masked_texts_are_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(pii, "_PART", 7)
    monkeypatch.setattr(pii, "_BLOCK", 3)
    rows = [*corpus(), (900, "a@b.cc" + "\n é\U0001f600 " * 50 + "9.9.9.9 4111111111111111+14111111111111111 x"), (901, " ".join(f"u{i}@h.org" for i in range(100)))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, loom_0 string, spans int")
    spans = {(r.doc_id, r.digest): r.spans for r in pii.find_spans(docs).collect()}
    found = pii.sanitise(docs)
    assert found.columns == docs.columns
    want = [(i or -1, t and plain_mask(t, spans[i, hashlib.sha256(t.encode()).hexdigest()])) for i, t in rows]
    assert sorted((r.doc_id or -1, r.text or "") for r in found.collect()) == sorted((i, t or "") for i, t in want)
    assert "[EMAIL TERM]" in " ".join(t or "" for _, t in want)
