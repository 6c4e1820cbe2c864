from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from corpusloom.llm import sanitising
from tests.llm import cases

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def counts(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if counts(k, m.group())]


def terms(texts):
    """Revealing words by the rules of the module, with plain loops. Only for texts whose identifiers are emails."""
    near, docs_with = defaultdict(list), defaultdict(set)
    entity_docs, kind_docs = defaultdict(set), set()
    beginning = lambda w: [w[:4] + "*"] if len(w) > 4 else []
    for d, text in enumerate(texts):
        for m in re.finditer(r"[^\W\d_]+", text or ""):
            for form in [m.group().lower(), *beginning(m.group().lower())]:
                docs_with[form].add(d)
        hits = [(s, e) for _, s, e in base(text)]
        for k, (s, e) in enumerate(hits):
            entity = text[s:e].lower()
            entity_docs[entity].add(d)
            kind_docs.add(d)
            left = max(hits[k - 1][1] if k else 0, s - 200)
            right = min(hits[k + 1][0] if k + 1 < len(hits) else len(text), e + 200)
            for a, b in ((left, s), (e, right)):
                words = [(m.group().lower(), m.start() + a, m.end() + a) for m in re.finditer(r"[^\W\d_]+", text[a:b])]
                for i, (word, x, y) in enumerate(words):
                    if b - a == 200 and (y == b if a == e else x == a):
                        continue
                    context = (a == e, words[i - 1][0] if i else None, words[i + 1][0] if i + 1 < len(words) else None)
                    near[entity].append((d, word, x, y, context))
    out = [set() for _ in texts]
    for entity, each in near.items():
        told = set()
        forms = defaultdict(lambda: (set(), set()))
        for d, word, _, _, context in each:
            for form in [word, *beginning(word)]:
                forms[form][0].add(d)
                forms[form][1].add(context)
        for form, (both, contexts) in forms.items():
            if len(contexts) >= 3 and len(both) * len(kind_docs) > len(docs_with[form]) * len(entity_docs[entity]) and len(docs_with[form]) <= 2 * len(both):
                told.add(form)
        for d, word, x, y, _ in each:
            if word in told:
                stem = beginning(word)
                out[d].add((x, y, stem[0] if stem and stem[0] not in told else ""))
    return out


def corpus():
    rng = random.Random(8)
    out = []
    for k in range(60):
        text = cases.sentence(rng, 20).replace("w", "wort") + f" mail{k}@x.org " + cases.sentence(rng, 90)
        out.append(text)
    for k in range(9):  # a name beside one address, in different contexts
        out.append(f"{rng.choice('abcdefg')}x Zorblax {rng.choice('hijkl')}y writes from zor@home.example about quellon {rng.choice('mnop')}z")
    out += ["Zorbing is fun", *[f"zorb{x} dance quellen" for x in "abcdefghijkl"]]
    out += [out[-1], "copy of nothing Hapax once@only.example"] + ["the same Copycat text same@copy.example again"] * 12
    return out


def test_words_that_reveal_an_entity(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in sanitising.personal_data(cases.plain(spark, texts)).collect()}
    want = terms(texts)
    for k in range(len(texts)):
        assert {tuple(t) for t in got[k]["terms"]} == want[k], texts[k]
    shown = {texts[60][s:e]: what for s, e, what in want[60]}
    assert shown["Zorblax"] == "zorb*" and "quellon" in shown
    assert not any(want[k] for k in range(60)) and not any(want[69:])
    clean = {r["doc_id"]: r for r in sanitising.sanitise(cases.plain(spark, texts)).collect()}
    assert "zorb* " in clean[60]["text"] and "[email]" in clean[60]["text"] and "Zorblax" not in clean[60]["text"] and "zor@home" not in clean[60]["text"]
    assert clean[69]["text"] == "Zorbing is fun" and clean[69]["score"] == "x"


def awkward():
    rng = random.Random(2)
    alphabet = ["a", "b@", "@", ".", "c.d", "1", "23", "256", " ", "-", "+", "(", ")", "é", "😀", "_", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567", "00"]
    out = [None, "", "4111111111111111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "001.002.003.004", "1.2.3.999", "a@b.c_d@e.f", "a@b.c.x@y.com", "+1 (555) 010-9999 +2"]
    out += ["a" * 50_000 + "@", "1" * 50_000, "a@b" + ".c" * 20_000, "1." * 20_000, " x@y.zz" * 3000]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]


def test_identifiers_agree_with_plain_patterns(spark):
    texts = awkward()
    got = sanitising.digests(sanitising.personal_data(cases.plain(spark, texts).repartition(4))).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        spans = base(text)
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in spans) for k in PATTERNS], repr(text)[:200]
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("term")) == shown


def test_awkward_rows_and_empty_table(spark):
    docs = cases.documents(spark)
    assert sanitising.personal_data(docs).count() == docs.count()
    clean = sanitising.sanitise(docs)
    assert clean.columns == docs.columns
    assert sorted(map(str, clean.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert sanitising.personal_data(cases.empty(spark)).count() == 0
    assert sanitising.sanitise(cases.empty(spark)).count() == 0
