import random

from pyspark.sql import functions as F

from cavitas.llm import substring_automaton, substring_dedup


def test_automata_agree_with_the_hash_form(spark, docs):
    rng = random.Random(8)
    passages = [[f"p{k}w{rng.randrange(6)}" for k in range(rng.randint(10, 40))] for _ in range(8)]
    rows = [(rng.randrange(-20, 200), " ".join(w for _ in range(rng.randint(0, 4)) for w in (rng.choice(passages) if rng.random() < 0.6 else [f"x{rng.randrange(30)}" for _ in range(20)]))) for _ in range(150)]
    rows += [(300, None), (301, ""), (302, "a " * 4000), (303, "a " * 30), (None, " ".join(passages[0])), rows[0]]
    want = substring_dedup.remove_repeats(docs(rows), keep_text=False).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))
    want = sorted(map(tuple, want.collect()), key=str)
    for words in (10**6, 2_000):
        assert sorted(map(tuple, substring_automaton.remove_repeats(docs(rows), shard_words=words).collect()), key=str) == want
    assert sum(r[2] for r in want) > 500
    few = docs([(1, " ".join(passages[1]))])
    against = {r.doc_id: r.n_removed for r in substring_automaton.remove_repeats(docs([(2, " ".join(passages[1])), (3, "y " * 20)]), few).collect()}
    assert against == {2: len(passages[1]) if len(passages[1]) >= 13 else 0, 3: 0}
    assert substring_automaton.remove_repeats(docs([])).count() == 0
