"""Trained models against the ``tokenizers`` library (models written by hand, none is trained), and tokenizer files that hold one."""

from __future__ import annotations

import json
import random

import pytest
from tokenizers import Tokenizer as Reference
from tokenizers import models, pre_tokenizers

from tonegrid.config import TokenizerConfig
from tonegrid.operators.scores import ScoreTables
from tonegrid.operators.subword import SubwordModel, UnigramModel, WordPieceModel, load_model
from tonegrid.plans.tokenizer import Tokenizer

LETTERS = "abcé"
NOTE = "score_id long, track_idx int, program int, time long, duration long, pitch int, velocity int"


def texts(rng, letters=LETTERS):
    return ["", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400))]


def merges(rng, n, marks=False):
    """Chained merges: every piece made can be part of another."""
    pieces, pairs = list(LETTERS), []
    while len(pairs) < n:
        a, b = rng.choice(pieces), rng.choice(pieces)
        if a + b not in pieces and len(a + b) < 12:
            pieces.append(a + b)
            pairs.append((a, b))
    return {p: i for i, p in enumerate(pieces)}, pairs


def same(reference: Reference, cases):
    own = load_model(reference.to_str())
    for t in cases:
        assert own.encode(t) == reference.encode(t, add_special_tokens=False).ids, t
    return own


@pytest.mark.parametrize("seed", range(4))
def test_chained_byte_pairs(seed):
    rng = random.Random(seed)
    vocabulary, pairs = merges(rng, 40)
    own = same(Reference(models.BPE(vocabulary, pairs)), texts(rng))
    assert isinstance(own, SubwordModel) and own.longest > 4


def test_byte_pairs_with_a_space_mark():
    rng = random.Random(9)
    vocabulary, pairs = merges(rng, 30)
    vocabulary |= {"▁": len(vocabulary)}
    for end in ("a", "b", "ab" if "ab" in vocabulary else "c"):
        vocabulary["▁" + end] = len(vocabulary)
        pairs.append(("▁", end))
    reference = Reference(models.BPE(vocabulary, pairs))
    reference.pre_tokenizer = pre_tokenizers.Metaspace()
    own = same(reference, texts(rng))
    assert own.marks.space == "▁" and own.plain("▁ab") == "ab"


@pytest.mark.parametrize("seed", range(4))
def test_unigrams(seed):
    rng = random.Random(seed)
    pieces = {"<unk>": 0.0} | {c: rng.uniform(-9, -1) for c in LETTERS}
    while len(pieces) < 50:
        pieces["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 6)))] = rng.uniform(-9, -1)
    reference = Reference(models.Unigram(list(pieces.items()), 0, False))
    own = same(reference, texts(rng))
    assert isinstance(own, UnigramModel)
    # Letters without a piece, alone and in a row.
    same(reference, texts(rng, LETTERS + "xyz"))


def test_unigrams_with_equal_scores_and_none_for_unknown():
    rng = random.Random(3)
    pieces = [("<unk>", 0.0), *((c, -2.0) for c in LETTERS), ("ab", -4.0), ("bc", -4.0), ("abc", -6.0), ("ca", -3.0), ("aa", -4.0)]
    same(Reference(models.Unigram(pieces, 0, False)), texts(rng))
    with pytest.raises(ValueError, match="no piece"):
        UnigramModel((("a", -1.0),)).encode("ab")


@pytest.mark.parametrize("seed", range(3))
def test_word_pieces(seed):
    rng = random.Random(seed)
    pieces = ["[UNK]", *LETTERS, *("##" + c for c in LETTERS if c != "c")]
    pieces += list(dict.fromkeys(rng.choice(("", "##")) + "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 5))) for _ in range(40)))
    reference = Reference(models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=50))
    own = same(reference, texts(rng) + texts(rng, LETTERS + "x"))
    assert isinstance(own, WordPieceModel) and own.most_letters == 50


def test_unknown_kinds():
    with pytest.raises(ValueError, match="WordLevel"):
        load_model('{"model": {"type": "WordLevel", "vocab": {"a": 0}}}')


def score(spark):
    rng = random.Random(1)
    notes = [(1, 0, 0, 120 * k, 240, rng.choice((60, 62, 64)), 90) for k in range(60)]
    scores = spark.createDataFrame([(1, 480)], "score_id long, tpq int")
    return ScoreTables(scores, spark.createDataFrame(notes, NOTE))


@pytest.mark.parametrize("kind", ["BPE", "Unigram", "WordPiece"])
@pytest.mark.parametrize("split", ["bar", "beat", "no"])
def test_a_file_with_a_model(spark, tmp_path, kind, split):
    """The file's own ids and characters count, and what is encoded decodes to the same tokens."""
    plain = Tokenizer.of("TSD", TokenizerConfig(encode_ids_split=split))
    names = list(plain.vocabulary.parts[0])
    random.Random(2).shuffle(names)
    base, letters = {t: i for i, t in enumerate(names)}, {chr(0x4E00 + i): t for i, t in enumerate(names)}
    of = {t: c for c, t in letters.items()}
    common = [of["Velocity_91"] + of["Duration_0.4.8"], of["Pitch_60"] + of["Velocity_91"], of["Pitch_60"] + of["Velocity_91"] + of["Duration_0.4.8"]]
    if kind == "BPE":
        m = models.BPE({p: i for i, p in enumerate([*letters, *common])}, [tuple(common[0]), tuple(common[1]), (of["Pitch_60"], common[0])])
    elif kind == "Unigram":
        m = models.Unigram([("<unk>", -99.0), *((c, -5.0) for c in letters), *((c, -6.0) for c in common)], 0, False)
    else:
        m = models.WordPiece({p: i for i, p in enumerate(["[UNK]", *letters, *("##" + c for c in letters), *common, "##" + common[0]])}, unk_token="[UNK]", max_input_chars_per_word=10_000)
    file = {"tokenization": "TSD", "config": plain.config.to_dict(), "_model": Reference(m).to_str(), "_vocab_base": base, "_vocab_base_byte_to_token": letters}
    (tmp_path / "t.json").write_text(json.dumps(file))
    t = Tokenizer.load(str(tmp_path / "t.json"))
    assert t.is_trained and not plain.is_trained and t.vocabulary.ids[0] == base and t.config == plain.config
    p = t.preprocess(score(spark))
    ids = t.ids(t.encode(p, preprocessed=True)).cache()
    order = lambda df: [r.id for r in df.orderBy("seq_idx", "pos").collect()]
    assert order(ids) == [base[r.token] for r in ids.orderBy("pos").collect()]
    encoded = t.encode_ids(ids, p).cache()
    assert encoded.count() < ids.count() and order(t.decode_ids(encoded)) == order(ids)
    if split == "no":
        text = "".join(of[r.token] for r in ids.orderBy("pos").collect())
        assert order(encoded) == Reference(m).encode(text, add_special_tokens=False).ids


def test_files_that_do_not_fit(tmp_path):
    values = {"tokenization": "TSD", "config": TokenizerConfig().to_dict()}
    for more in ({"_vocab_base": {"Pitch_60": 0, "Pitch_61": 2}}, {"_vocab_base": {"Pitch_60": 0, "Pitch_61": 1}, "_vocab_base_byte_to_token": {"a": "Pitch_60"}}):
        (tmp_path / "t.json").write_text(json.dumps(values | more))
        with pytest.raises(ValueError):
            Tokenizer.load(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="no trained model"):
        Tokenizer.of("TSD").decode_ids(None)
