"""Token ids of many texts, as the vocabulary's own library gives them, at a fraction of its cost.

``tokenizers`` builds tokens, offsets and masks that packing doesn't need. ``tiktoken`` has the same vocabulary as ranks and the same splitting
pattern. The two can differ only where their Unicode tables do, so texts whose characters all lie in long-settled blocks (up to Latin Extended,
general punctuation) go to ``tiktoken``, and all others to ``tokenizers``. Special strings inside texts count as special in both, as is the
default of ``tokenizers``. The pattern of ``tiktoken`` needs a stack as deep as a run of white space is long, so a text with a very long run goes
to the resynchroniser, whose library needs none, and so does every text beyond the settled blocks that is longer than one of its chunks.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

from .token_count import CHUNK, Resynchroniser, load_tokenizer

#: Characters whose categories no Unicode version since 5.0 has changed: Basic Latin to Latin Extended-A without C1 controls, dashes to ellipsis.
_SETTLED = re.compile("[\x00-\x1b\x20-\x7e\xa0-ſ‐-‧]*")

#: White space that the pattern's stack certainly holds; it fails at some 900,000 characters.
DEEPEST = 50_000
_DEEP = re.compile(r"\s{%d}" % DEEPEST)


@lru_cache(maxsize=2)
def _ranked(path: str):
    """The rank reading of a byte-level BPE file, or None if its ranks aren't beside it or don't say the same."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(path) as f:
        whole = json.load(f)
    with open(ranks, "rb") as f:
        merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {x["content"]: x["id"] for x in whole["added_tokens"]}
    if whole["normalizer"] or len(merge) != len(whole["model"]["vocab"]):
        return None
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge, special_tokens=special)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids as unsigned 32-bit integers, without begin, end or added special tokens."""
    quick = _ranked(path)
    if quick is not None and _SETTLED.fullmatch(text) and not (len(text) > DEEPEST and _DEEP.search(text)):
        return quick.encode_to_numpy(text, allowed_special="all").astype("<u4")
    if len(text) > CHUNK:
        return np.array(Resynchroniser(path).ids(text), "<u4")
    return np.array(load_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4")
