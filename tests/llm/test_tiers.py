"""The nearest examples are exact whatever tier the search ends in."""

import numpy as np

from tablemill.llm import toxicity


def test_nearest_by_tiers_against_all_cosines(monkeypatch):
    rng = np.random.default_rng(4)
    examples, terms = 400, 300
    # few heavy terms and many light ones
    share = np.where(np.arange(terms) < 40, 3.0, 0.05)
    dense = rng.random((examples, terms)) * (rng.random((examples, terms)) < 0.2) * share
    dense[dense.sum(1) == 0, 0] = 1.0
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    row, term = np.nonzero(dense)
    exact, edges = dense[row, term], np.concatenate([[0], np.cumsum((dense > 0).sum(1))])
    order = np.argsort(term, kind="stable")
    ends = np.searchsorted(term[order], np.arange(terms), "right")
    monkeypatch.setattr(toxicity, "TIERS", (20, 50, 120))
    tier, tails = toxicity.tiers(term, exact, edges, terms)
    assert np.bincount(tier).tolist() == [20, 30, 70, 180] and not tails[-1].any()
    index = toxicity.Index(
        [str(t) for t in range(terms)], np.ones(terms), np.ones(terms, bool), np.zeros(examples), np.arange(examples), row[order].astype(np.int32),
        exact[order].astype(np.float32), np.stack([np.concatenate([[0], ends[:-1]]), ends], 1), tier, tails, term, exact, edges, 0.0, 0.0,
    )
    taken = []
    plain = toxicity.Index.cosines
    monkeypatch.setattr(toxicity.Index, "cosines", lambda self, query, near, places, out: taken.append(len(places)) or plain(self, query, near, places, out))
    for worth in (1, 100, 10_000):
        monkeypatch.setattr(toxicity, "WORTH", worth)
        taken.clear()
        for j in range(0, examples, 5):
            own = slice(edges[j], edges[j + 1])
            cos = dense @ dense[j]
            cos[j] = -1.0
            at, got = index.nearest(term[own], exact[own], 25, leave=j)
            assert np.allclose(got, np.sort(cos)[::-1][: len(got)]) and len(got) == min(25, (cos > 0).sum()) and np.allclose(cos[at], got)
        if worth == 10_000:  # tiers are read on until few are left
            assert sum(taken) < 80 * 40


def test_reader_counts_and_lists_the_same_terms():
    read = toxicity.reader(sorted(toxicity.terms("one ones onesie other others otherwise")))
    for text in ("One ones one, others; onesie", "nothing known", "", None):
        term, n = read(text)
        assert sorted(set(read(text, counted=False)[0].tolist())) == term.tolist() and len(n) == len(term)
    assert dict(zip(*map(list, read("one one")))) == {t: 2 for t in read("one")[0]}
