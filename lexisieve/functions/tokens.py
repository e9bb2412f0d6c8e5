"""Token expressions for line notation and for words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.barrier import evaluate_once
from lexisieve.session import small_side

# Two-letter atoms that are one token.
TWO_LETTER_ATOMS = ("Cl", "Br", "Na", "Si", "Li", "Se")

# The extra two-letter atoms of the learned-vocabulary tokeniser.
TWO_LETTER_ATOMS_EXTENDED = TWO_LETTER_ATOMS + ("Mg", "Zn")

# Token ids of the line-notation vocabulary. 1 starts a sequence
# and 2 ends and pads it; 0 is unused.
TOKEN_IDS = {
    ">": 1, "<": 2, "2": 3, "F": 4, "Cl": 5, "N": 6, "[": 7, "6": 8, "O": 9, "c": 10,
    "]": 11, "#": 12, "=": 13, "3": 14, ")": 15, "4": 16, "-": 17, "n": 18, "o": 19,
    "5": 20, "H": 21, "(": 22, "C": 23, "1": 24, "S": 25, "s": 26, "Br": 27, "/": 28,
    "7": 29, "8": 30, "I": 31, "P": 32, "9": 33, "@": 34, "p": 35, "+": 36, "\\": 37,
    "K": 38, "B": 39, "Na": 40, "Si": 41, "Li": 42, "Se": 43,
}

START_ID = 1
END_ID = 2

BOS, EOS, PAD, UNK = "<bos>", "<eos>", "<pad>", "<unk>"
SPECIALS = (BOS, EOS, PAD, UNK)


def atom_pattern(atoms: Sequence[str] = TWO_LETTER_ATOMS) -> str:
    """Two-letter atoms, then ``%dd`` ring labels, then any one character.

    ``(?d)`` makes only the line feed a line end, so a carriage return is a token.
    """
    return "(?d)(" + "|".join([*atoms, "%[0-9][0-9]", "."]) + ")"


def atom_tokens(text: Column, atoms: Sequence[str] = TWO_LETTER_ATOMS) -> Column:
    return F.regexp_extract_all(text, F.lit(atom_pattern(atoms)), F.lit(1))


def word_tokens(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: w != "")


def vocabulary_map(ids: Mapping[str, int] = TOKEN_IDS) -> Column:
    """A small vocabulary as one literal map column."""
    return F.create_map(*[F.lit(v) for pair in ids.items() for v in pair])


def all_known(tokens: Column, known: Sequence[str] | None = None) -> Column:
    """True when every token is in the vocabulary; null text gives false."""
    words = list(TOKEN_IDS) if known is None else list(known)
    unknown = F.array_except(tokens, F.array(*[F.lit(w) for w in words]))
    return F.coalesce(F.size(F.array_compact(unknown)) == 0, F.lit(False)) & tokens.isNotNull()


def token_ids(tokens: Column, ids: Mapping[str, int] = TOKEN_IDS) -> Column:
    vocab = vocabulary_map(ids)
    return F.transform(tokens, lambda t: F.try_element_at(vocab, t))


def encode(tokens: Column, pad: int = 50, ids: Mapping[str, int] = TOKEN_IDS) -> Column:
    """Start id, token ids cut so the whole is at most ``pad`` - 1 long, end id
    up to exactly ``pad``. Tokens beyond the cut are not looked up."""
    kept = F.slice(tokens, F.lit(1), F.lit(max(pad - 2, 0)))
    body = F.concat(F.array(F.lit(START_ID)), token_ids(kept, ids))
    return F.slice(F.concat(body, F.array_repeat(F.lit(END_ID), pad)), 1, pad)


def encode_whole(tokens: Column, ids: Mapping[str, int] = TOKEN_IDS) -> Column:
    """Start id, the ids of all tokens, end id: :func:`encode` with room for the whole text."""
    return F.concat(F.array(F.lit(START_ID)), token_ids(tokens, ids), F.array(F.lit(END_ID)))


def encoded_length(tokens: Column, pad: int = 50) -> Column:
    return F.least(F.size(tokens) + 1, F.lit(pad - 1))


def decode(encoded: Column, ids: Mapping[str, int] = TOKEN_IDS) -> Column:
    """Text before the first end id; start and unused ids are skipped."""
    names = F.create_map(*[F.lit(v) for word, i in ids.items() for v in (i, word)])
    end = F.array_position(encoded, F.lit(END_ID)).cast("int")
    body = F.when(end > 0, F.slice(encoded, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(encoded)
    kept = F.filter(body, lambda i: i > END_ID)
    return F.array_join(F.transform(kept, lambda i: F.element_at(names, i)), "")


def encode_with_vocab(tokens: Column, vocab: Column, unk_id: Column, bos: Column | None = None,
                      eos: Column | None = None) -> Column:
    """Ids by a map column; tokens outside it become ``unk_id``."""
    ids = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(vocab, t), unk_id))
    if bos is not None:
        ids = F.concat(F.array(bos), ids)
    if eos is not None:
        ids = F.concat(ids, F.array(eos))
    return ids


def decode_with_vocab(ids: Column, names: Column, bos: Column | None = None,
                      eos: Column | None = None) -> Column:
    """Text of ids by an id-to-token map; ids outside it become the unknown mark."""
    body = ids
    if bos is not None:
        body = F.when(F.get(body, F.lit(0)) == bos, F.slice(body, F.lit(2), F.size(body))).otherwise(body)
    if eos is not None:
        body = F.when(
            (F.size(body) > 0) & (F.try_element_at(body, F.lit(-1)) == eos),
            F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0))),
        ).otherwise(body)
    return F.array_join(F.transform(body, lambda i: F.coalesce(F.try_element_at(names, i), F.lit(UNK))), "")


def encode_by_join(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame, specials: Mapping[str, int]) -> DataFrame:
    """``id``, ``ids``: begin mark, ids of the tokens by join with ``token, id``, end mark.

    The vocabulary may have any size; tokens outside it get the unknown id. A
    row travels as its distinct tokens, which are joined, and as the places of
    its tokens among them, not as a text per token. Rows are put together again
    by id, so ids have to be unique.
    """
    kinds = evaluate_once(df.select(id_col, F.col(tokens_col).alias("__tokens")), __kinds=F.array_distinct("__tokens"))
    coded = kinds.select(id_col, F.transform("__tokens", lambda t: F.array_position("__kinds", t).cast("int")).alias("__places"))
    each = kinds.select(id_col, F.posexplode("__kinds").alias("place", "token"))
    unknown = F.lit(specials[UNK]).cast("long")
    named = each.join(small_side(vocab.select("token", F.col("id").alias("__id"))), "token", "left").groupBy(id_col).agg(F.sort_array(F.collect_list(
        F.struct("place", F.coalesce(F.col("__id").cast("long"), unknown).alias("id")))).alias("__named"))
    by_place = evaluate_once(coded.select(id_col, "__places").join(named, id_col, "left"), __ids=F.col("__named.id"))
    body = F.transform(F.coalesce("__places", F.array().cast("array<int>")),
                       lambda p: F.coalesce(F.get("__ids", p - 1), unknown))
    mark = lambda name: F.array(F.lit(specials[name]).cast("long"))
    return by_place.select(id_col, F.concat(mark(BOS), body, mark(EOS)).alias("ids"))
