"""Groups of near copies against brute force: bridges, hubs, chains and dense groups, below and above every limit."""

import collections
import random

import numpy as np
import pytest

from cairn.llm import near_copies


def words_of(chance, n):
    return ["".join(chance.choice("etaoinshrdlu") for _ in range(chance.randint(3, 8))) + str(chance.randrange(1000)) for _ in range(n)]


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(texts):
    """The smallest place of each text's group, by all pairs."""
    sets = [grams(t.split()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def chain(chance, text, steps, change):
    """Texts each of which differs from the one before in a run of ``change`` words; far ends have little in common."""
    out = [list(text)]
    at = 0
    for _ in range(steps):
        new = list(out[-1])
        new[at : at + change] = words_of(chance, change)
        at = (at + change) % (len(text) - change)
        out.append(new)
    return out


def found_groups(spark, texts):
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row bigint, doc_id bigint, text string")
    return {r.row: r.group for r in near_copies.grouped(frame, 5, 0.8).collect()}


@pytest.mark.parametrize("shingles, limit, few", [(500_000, 2000, 16), (3000, 5, 16), (1500, 3, 1)])
def test_groups_equal_all_pairs_at_every_limit(spark, monkeypatch, shingles, limit, few):
    """Two dense groups joined by one chain of links (a bridge), a hub, a long chain, and copies close to the threshold on both sides."""
    for name, value in (("SHINGLES", shingles), ("LIMIT", limit), ("FEW", few)):
        monkeypatch.setattr(near_copies, name, value)
    chance = random.Random(4)
    base = words_of(chance, 100)
    bridge = chain(chance, base, 12, 5)
    texts = list(bridge)
    for end in (bridge[0], bridge[-1]):
        for _ in range(25):
            copy = list(end)
            copy[chance.randrange(100)] = words_of(chance, 1)[0]
            texts.append(copy)
    texts += chain(chance, words_of(chance, 90), 30, 4)
    hub = words_of(chance, 120)
    texts.append(hub)
    for _ in range(20):
        copy = list(hub)
        for at in chance.sample(range(120), chance.randint(1, 5)):
            copy[at] = words_of(chance, 1)[0]
        texts.append(copy)
    texts += [words_of(chance, 60) for _ in range(20)]
    chance.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    want, got = brute_groups(texts), found_groups(spark, texts)
    pairs = collections.Counter((want[i], got[i]) for i in range(len(texts)))
    assert len({w for w, _ in pairs}) == len(pairs)  # no group of all pairs is in two parts
    assert len({g for _, g in pairs}) == len(pairs)  # and none holds two


@pytest.mark.parametrize("many", [60, 2600])
def test_a_bridge_joins_groups_of_any_size(spark, many):
    """Two groups of near copies whose only connection is a chain of links: one group, however many copies each has."""
    chance = random.Random(9)
    bridge = chain(chance, words_of(chance, 200), 12, 10)
    texts = list(bridge)
    for end in (bridge[0], bridge[-1]):
        for _ in range(many):
            copy = list(end)
            copy[chance.randrange(200)] = f"x{chance.randrange(10**9)}"
            texts.append(copy)
    texts = [" ".join(t) for t in texts]
    assert len(set(found_groups(spark, texts).values())) == 1


def test_pairs_in_a_key_are_pairs_that_were_compared():
    chance = np.random.default_rng(7)
    near = lambda a, bits: a ^ np.array([sum(1 << int(b) for b in chance.choice(64, bits, replace=False)) for _ in range(4)], np.uint64)
    rows = [chance.integers(0, 1 << 63, 4).astype(np.uint64)]
    for _ in range(30):
        rows.append(near(rows[-1], 13))
    prints, keys = np.stack(rows), np.repeat([1, 2], [20, 11])
    a, b = near_copies.near_pairs(keys, prints)
    assert (keys[a] == keys[b]).all() and (np.bitwise_count(prints[a] ^ prints[b]).sum(1) <= near_copies.WIDE).all()
    joined = {(int(i), int(j)) for i, j in zip(a, b)}
    assert {(i, i + 1) for i in range(30) if i != 19} <= joined and len(joined) < 31


def test_pivots_discard_pairs_and_lose_none(monkeypatch):
    """A key of 60 near prints and 60 strangers: pivots tell them apart, and the components are those of all pairs."""
    chance = np.random.default_rng(8)
    turned = lambda a, bits: a ^ np.packbits(np.isin(np.arange(256), chance.choice(256, bits, replace=False))).view(np.uint64)
    middle = chance.integers(0, 1 << 63, 4).astype(np.uint64)
    rows = [turned(middle, int(chance.integers(24, 34))) for _ in range(60)] + list(chance.integers(0, 1 << 63, (60, 4)).astype(np.uint64))
    prints, keys = np.stack(rows), np.repeat([3, 5], [120, 120])
    prints = np.concatenate([prints, prints[chance.permutation(120)]])
    compared, plain = [0], near_copies.differing
    monkeypatch.setattr(near_copies, "differing", lambda a, b: (compared.__setitem__(0, compared[0] + len(a)), plain(a, b))[1])
    a, b = near_copies.near_pairs(keys, prints)
    some, every = np.arange(240), np.arange(240)
    some = near_copies._joined(some, a, b)
    i, j = np.triu_indices(240, 1)
    near = (keys[i] == keys[j]) & (plain(prints[i], prints[j]) <= near_copies.WIDE)
    assert (some == near_copies._joined(every, i[near], j[near])).all()
    # 60 * 60 pairs of a stranger and a near print in each key, and of these hardly any is compared; strangers meet strangers.
    assert compared[0] < 2 * (60 * 59 // 2 + 60 * 59 // 2 + 60 * 60 // 10)
