"""What a word is, here and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are the longest runs of anything but these ASCII characters: space, tab, LF, VT, FF, CR.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)

#: Outside these ranges lie characters that the tokenizer libraries' own splitters and the regex module class by different
#: versions of Unicode. Texts that hold one go to the library whole.
AGREED = re.compile("[\u0000-՗֐-ࢎऀ-౛฀-₎₠-ꟍ가-퟿-￿\U0001f000-\U0001faff\U00020000-\U0002b739]*")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
