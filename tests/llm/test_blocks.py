import numpy as np

from tallymark.llm.blocks import pairs_in_groups


def test_pairs_in_groups():
    r = np.random.RandomState(3)
    for i, j in ((0, 0), (0, 1), (2, 5)):
        key, block = r.randint(0, 9, 120), r.choice([i, j], 120)
        got = [tuple(sorted(p)) for x, y in pairs_in_groups(key, block, i, j, most=50) for p in zip(x.tolist(), y.tolist(), strict=True)]
        want = {(a, b) for a in range(120) for b in range(a + 1, 120) if key[a] == key[b] and {block[a], block[b]} == {i, j}}
        assert len(got) == len(set(got)) and set(got) == want
