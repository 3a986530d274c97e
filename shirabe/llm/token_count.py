"""Token counts: how many tokens each text has, without its ids.

Texts are cut at safe boundaries (:func:`shirabe.llm.bpe.safe_pieces`; between words, and in longer runs without
blanks where no merge can cross), so a long text never goes to the library whole but for a run that has no such
place. Distinct pieces are encoded in calls balanced by bytes, each text's lengths are summed by numpy, and the
Arrow function returns nothing but these. No shuffle.

Defined results: null text, null count; empty text, 0. Repeated rows stay, an empty table stays empty, other
columns are carried (``<name>_in`` where they bear the output's name).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import DEFAULT_TOKENIZER, codec, safe_pieces
from .common import map_text, utf8_parts, with_nulls


def count_arrow(text: pa.Array, path: str) -> pa.Array:
    data, off, valid = utf8_parts(text)
    c = codec(path)
    codes, pieces, piece_off = safe_pieces(data, off, c.meet)
    slot = c.slots(pieces)
    each = c.count[slot[codes]]
    total = np.append(0, np.cumsum(each))
    return with_nulls(pa.array(total[piece_off[1:]] - total[piece_off[:-1]]), valid)


def token_counts(df: DataFrame, text_col: str = "text", path: str = DEFAULT_TOKENIZER, out_col: str = "n_tokens", keep_text: bool = False) -> DataFrame:
    """Add ``out_col``, the number of tokens of ``text_col``."""
    return map_text(df, text_col, [(out_col, T.LongType())], lambda: lambda text: [count_arrow(text, path)], drop=() if keep_text else (text_col,))
