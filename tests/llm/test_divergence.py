import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, item string, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    groups, docs, own = set(), Counter(), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        own[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    share = lambda c, of: 1 + 1_000_000_000 * (c + 2) // of
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        total = lambda c: sum(c[t] for t in kept) + 2 * len(kept)
        mine, all_ = own[lang, source], sum((own[g] for g in groups if g[0] == lang), Counter())
        pairs = []
        for other in (s for x, s in groups if x == lang and s != source):
            theirs = own[lang, other]
            pairs.append((other, sum(f(share(mine[t], total(mine)), share(theirs[t], total(theirs))) for t in kept)))
        over = []
        for t in kept:
            p, q = share(mine[t], total(mine)), share(all_[t], total(all_))
            if mine[t] and p > q:
                over.append((t, f(p, q)))
        for part, values, most in (("pair", pairs, len(pairs)), ("term", over, top)):
            ordered = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, v, r) for r, (item, v) in enumerate(ordered, 1)]
    return sorted(out)


def docs_of(n):
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉPSILON", "zeta_eta", "theta9iota", "KK", "\x00nul", "Ω"]
    rows = []
    for i in range(n):
        text = " ".join(words[(i * k + k * k) % (3 + i % 8)] for k in range(i % 23))
        rows.append((i, text if i % 17 else None, ["en", "de", None, ""][i % 4 if i % 5 else 0], ["a", "b", "c", None, ""][i % 5 if i % 2 else 0], "x", 7))
    return rows + [(n, "lonely words only", "fr", "a", "x", 7), (n + 1, None, "fr", "b", "x", 7), (n + 2, "", "it", None, "x", 7)]


def test_equals_brute_force(spark):
    rows = docs_of(400)
    for block_terms in (2, 16_384):
        got = divergence.audit(spark.createDataFrame(rows, DOCS), min_docs=10, top=3, block_terms=block_terms)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 3)


def test_empty_table_long_text_and_repeated_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert divergence.audit(empty).collect() == []
    rows = [(1, "many words " * 100_000, "en", "a", "x", 7)] * 10 + [(2, "many others", "en", "b", "x", 7)] * 10
    assert sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS)).collect()) == brute(rows, 10, 10)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 3000), max_size=300), st.sets(st.integers(0, 3000), max_size=300), st.integers(1, 70))
def test_gallop_is_an_intersection(a, b, stretch):
    a, b = (np.array(sorted(x), np.int64) for x in (a, b))
    i, j = divergence.gallop(a, b, stretch)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@given(st.integers(0, 10**13), st.integers(1, 10**13))
def test_shares_are_exact(count, rest):
    of = count + 2 + rest
    assert divergence.shares(np.array([count], np.int64), of)[0] == 1 + 10**9 * (count + 2) // of
