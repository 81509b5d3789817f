"""The coder of operator 5: size, blocks by themselves, bounds."""

import numpy as np
import pytest

from marginalia.llm import id_files


def sentences(n: int) -> np.ndarray:
    """Ids of which many follow one that they followed before."""
    r = np.random.default_rng(7)
    phrases = [np.minimum(r.zipf(1.2, 6), 50_000) for _ in range(400)]
    return np.concatenate([phrases[k] for k in np.minimum(r.zipf(1.3, n // 6) - 1, 399)]).astype("<u4")


def test_each_state_has_its_own_chance():
    """Chances move by state and block; one weight for all states of an order took 6.3 bits an id here."""
    ids = sentences(60_000)
    blocks = id_files.encode(ids, 50_257)
    assert (id_files.decode(blocks, len(ids), 50_257) == ids).all()
    assert 8 * sum(map(len, blocks)) / len(ids) < 6.2


def test_a_block_ends_with_one_digit():
    assert [len(b) for b in id_files.encode(np.array([7], "<u4"), 50_257)] == [3]


@pytest.mark.parametrize("block", [1, 7, 512])
def test_blocks_stand_by_themselves(block, monkeypatch):
    ids = np.concatenate([sentences(600), np.array([131_071, 0, 131_070] * 40, "<u4")])
    blocks = id_files.encode(ids, id_files.MOST, block)
    for lanes in (1, 3):
        monkeypatch.setattr(id_files, "LANES", lanes)
        assert id_files.encode(ids, id_files.MOST, block) == blocks
        assert (id_files.decode(blocks, len(ids), id_files.MOST, block) == ids).all()


def test_damage_anywhere_is_refused():
    ids = sentences(3000)
    data = id_files.pack_container([1], np.array([len(ids)]), ids, 50_257)
    for at in range(5, len(data), 397):
        bad = bytearray(data)
        bad[at] ^= 129
        with pytest.raises(ValueError):
            id_files.open_container(bytes(bad))


def test_chunks_that_came_again_stay_known():
    """A full memory drops the chunks that came once, not those that came again."""
    import pyarrow as pa

    from marginalia.llm import tokens

    handed = []

    def encode(texts):
        handed.extend(texts)
        return [[len(t), *t.encode()] for t in texts]

    coder = tokens.Encoder(encode, "byte", most=20)
    for k in range(9):
        text = " ".join(["the", "same", "words", *(f"new{k}x{i}" for i in range(8))])
        ids, _ = coder.batch(pa.array([" " + text]))
        assert ids.tolist() == [x for w in ["", *text.split(" ")] for x in [len(w) + (w != ""), *(" " * (w != "") + w).encode()]]
        assert len(coder.number) <= 20 + 12
    assert handed.count(" same") == 1 and len(set(handed)) == len(handed)
