import random
import re

from cavitas.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = [(i, label) for i in range(len(words)) for phrase, label in license_scan.BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_against_brute_force(spark, stored):
    rng = random.Random(4)
    pieces = ["cc", "by", "CC BY", "general", "public", "license", "General Public License", "all rights reserved", "all", "rights", "reserved", "the", "GNU", "licensed", "under", "é", "x!", "\n", "cc-by-nc", "you may", "of"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "cc by " * 40_000), (None, "all rights reserved"), (303, "cc by"), (304, "cc by"), (304, "cc by")]
    got = license_scan.op2_license_scan(spark, stored(rows)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_templates_and_chains():
    s = license_scan.scanner()
    for label, texts in license_scan.TEMPLATES.items():
        for t in texts:
            assert label in s.scan(f"Some words before. {t} And after.".encode())[5].split(",")
    words = license_scan.TEMPLATES["bsd"][0].split()
    edited = " ".join(w for i, w in enumerate(words) if i not in (5, 12))
    assert s.scan(edited.encode())[5] == "bsd" and s.scan(edited.encode())[6] < 1
    assert s.scan(b"source and binary are words of the language")[5:] [0] == ""
    assert s.scan(b"nothing here")[5:] == ("", 0.0, [])


def test_near_misses_and_interruptions():
    s = license_scan.scanner()
    for text in ("released under the name of the band", "licensed under the age of a license", "you may not use this file", "subject to the terms of the treaty", "permission to use it for any purpose", "redistribution of wealth and use of binary options", "the software is free of charge", "under the terms of the public"):
        assert s.scan(text.encode())[5] == "" and s.scan(text.encode())[7] == [], text
    words = license_scan.words_of(license_scan.TEMPLATES["mit"][1].encode())
    for foreign in (b"page 3 of 9 draft of the annual report 2020", b"associated documentation files"):
        out = s.scan(b"x y " + b" ".join(words[:28]) + b" " + foreign + b" " + b" ".join(words[28:]))
        assert out[5] == "mit" and out[6] == 1.0 and out[7] == [("mit", 2, 2 + len(words) + len(foreign.split()), 1.0)]
    twice = s.scan(b" ".join(words) + b" and " + b" ".join(words))[7]
    assert [x[:3] for x in twice] == [("mit", 0, len(words)), ("mit", len(words) + 1, 2 * len(words) + 1)]
    by_sa = s.scan(license_scan.TEMPLATES["cc-by-sa"][0].encode())
    assert [x[0] for x in by_sa[7]] == ["cc-by-sa"]


def test_best_chains_against_all_chains():
    """Every chain of a few matches, by brute force."""
    rng = random.Random(6)
    for _ in range(300):
        size = rng.randint(4, 14)
        weight = [0.0]
        for _ in range(size):
            weight.append(weight[-1] + rng.choice([0.25, 1.0]))
        matches = set()
        for _ in range(rng.randint(1, 6)):
            n = rng.randint(1, min(4, size))
            to, start = rng.randint(n, size), rng.randrange(20)
            matches.add((start, start + n, to))
        matches = sorted(matches, key=lambda m: (m[1], m[2], m[0]))

        def value(chain):
            total, at, before = 0.0, None, None
            for start, end, to in chain:
                begin, skip = start, 0
                if at is not None:
                    begin = max(start, at)
                    skip = max(0, before - (to - (end - begin)))
                    if at >= end or before >= to or begin + skip >= end:
                        return None
                    total -= license_scan.PENALTY * (begin + skip - at)
                total += weight[to] - weight[to - (end - begin) + skip]
                at, before = end, to
            return total

        best = {}
        for bits in range(1, 1 << len(matches)):
            chain = [m for k, m in enumerate(matches) if bits >> k & 1]
            v = value(chain)
            if v is not None:
                best[chain[-1]] = max(best.get(chain[-1], -1.0), v)
        got = license_scan.best_chains(matches, weight)
        assert all(abs(got[k][0] - best[m]) < 1e-9 for k, m in enumerate(matches))


def test_matching_statistics():
    rng = random.Random(2)
    seqs = [[rng.randrange(4) for _ in range(12)] for _ in range(3)]
    a = license_scan.Automaton(seqs)
    factors = {tuple(s[i:j]) for s in seqs for i in range(12) for j in range(i + 1, 13)}
    for _ in range(300):
        q = [rng.randrange(5) for _ in range(20)]
        state = length = 0
        for i, w in enumerate(q):
            while state and w not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            state, length = (a.next[state][w], length + 1) if w in a.next[state] else (0, 0)
            assert length == max([0, *(n for n in range(1, i + 2) if tuple(q[i + 1 - n : i + 1]) in factors)])
            for number, end in a.ends[state] if length else ():
                assert seqs[number][end - length : end] == q[i + 1 - length : i + 1]


def test_empty(docs):
    assert license_scan.scan(docs([])).count() == 0


def labels_of(text):
    s = license_scan.scanner()
    out = s.scan(text.encode())
    return set(filter(None, out[5].split(","))) - set(filter(None, out[4].split(",")))


def test_siblings_are_told_apart():
    """Every notice of every licence, put among words, has its own label and no other of the method's."""
    rng = random.Random(9)
    filler = "the report was read in the town hall and license fees of the version were paid under protest by all".split()
    for label, texts in license_scan.TEMPLATES.items():
        for text in texts:
            around = [" ".join(rng.choices(filler, k=9)) for _ in range(2)]
            got = labels_of(f"{around[0]}. {text} {around[1]}") | ({label} & set(license_scan.BASE.values()))
            assert got == {label}, (text, got)


def test_notices_named_right():
    for text, label in {
        "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd",
        "The MIT License": "mit",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "It is licensed under the GNU Affero General Public License, version 3": "agpl",
        "photos licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
    }.items():
        assert labels_of(text) == {label}, text
    assert labels_of("Licensed under the MIT License or the Apache License, Version 2.0, at your option") == {"mit", "apache-2.0"}


def test_near_siblings_have_no_label():
    for text in (
        "licensed under the same flag, version 2.0", "Licensed under the Apache License, Version 1.1", "licensed under a creative attribution 4.0 international treaty", "licensed under the BSA 3-clause license",
        "released under the name of the license", "under the terms of the general license as published by the office", "you may obtain a copy of the license at the desk", "the license identifier is missing",
        "licensed under CC 4.0", "a creative commons for all", "this program is free for you to use and to modify", "subject to the terms of the public house, v. 2.0", "licensed under the lesser public house",
        "permission is granted to any person", "redistributions of wealth must retain the above", "this is free and open", "released into the public domain by the state", "licensed under a common attribution", "version 2.0 of the license fee", "under the lesser general's terms",
    ):
        assert labels_of(text) == set(), text
