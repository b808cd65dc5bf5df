"""Cut texts into chunks that respect code fences, paragraphs and sentences.

Everything runs as one JVM expression per text: no worker process and no
exchange, whatever the number or the length of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.lets import let
from docloom.functions.text import FENCE, TO_END, last_index, occurrences, strip

DEFAULT_SIZE = 5000
# Fixed value: a paragraph or sentence end counts only past this share of the size.
MIN_FILL = 0.3


# A long text is looked at in blocks of this many sizes, so that finding one
# chunk never costs more than a few blocks, however long the text is.
BLOCK_SIZES = 4
AHEAD = 3


def _block_of(position: Column, block: int) -> Column:
    return F.floor(position / block).cast("int")


def _from(blocks: Column, position: Column, block: int, count: Column) -> Column:
    """Text from ``position`` to the end of ``count`` blocks, the one it is in included."""
    near = F.array_join(F.slice(blocks, _block_of(position, block) + 1, count), "")
    return F.substring(near, position % block + 1, F.lit(TO_END))


def _taken(ahead: Column, later: Column, left: Column, size: int) -> Column:
    """Number of characters that the next chunk takes.

    ``ahead`` is the text that follows, at least two blocks of it; ``later`` the
    position of the next fence in all of the text, tried when ``ahead`` has none.
    """
    floor = F.lit(size * MIN_FILL)

    def choose(window: Column) -> Column:
        whole = F.length(window)
        near = F.locate(FENCE, ahead, size + 1)
        close = let(F.when(near > 0, near).otherwise(later), lambda c: F.when(c > 0, c + len(FENCE) - 1))
        paragraph = let(last_index(window, "\n\n"), lambda b: F.when(b > floor, b).otherwise(whole))
        sentence = let(last_index(window, ". "), lambda b: F.when(b > floor, b + 1).otherwise(whole))
        return (
            F.when(occurrences(window, FENCE) % 2 == 1, F.coalesce(close, left))
            .when(F.contains(window, F.lit("\n\n")), paragraph)
            .otherwise(sentence)
        )

    return let(F.substring(ahead, 1, size), choose)


def chunk_text(text: Column, size: int = DEFAULT_SIZE) -> Column:
    """``ARRAY<STRING>`` of the stripped, non-empty chunks of ``text`` in order.

    First the cuts are found as positions, then the pieces are taken. A step
    carries positions only, since Spark copies what a step carries.
    """
    block = size * BLOCK_SIZES
    # Every chunk but the last takes more than MIN_FILL * size characters.
    rounds = F.floor(F.length(text) / (size * MIN_FILL)).cast("int") + 1
    in_blocks = F.when(F.length(text) <= block, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    )

    def cut(blocks: Column, total: Column) -> Column:
        def next_end(start: Column) -> Column:
            rest = F.size(blocks) - _block_of(start, block)
            later = F.when(
                rest > AHEAD, F.locate(FENCE, _from(blocks, start, block, rest), size + 1)
            ).otherwise(0)
            return let(
                _from(blocks, start, block, F.lit(AHEAD)),
                lambda ahead: start + _taken(ahead, later, total - start, size),
            )

        def step(ends: Column, _: Column) -> Column:
            last = F.element_at(ends, -1)
            return F.when(last >= total, ends).otherwise(F.concat(ends, F.array(let(last, next_end))))

        return F.aggregate(F.sequence(F.lit(1), rounds), F.array(F.lit(0)), step)

    def pieces(blocks: Column, ends: Column) -> Column:
        def piece(end: Column, place: Column) -> Column:
            start = F.get(ends, place)
            count = _block_of(end - 1, block) - _block_of(start, block) + 1
            return strip(F.substring(_from(blocks, start, block, count), F.lit(1), end - start))

        return F.filter(F.transform(F.slice(ends, F.lit(2), F.size(ends)), piece), lambda p: p != "")

    def in_order(blocks: Column) -> Column:
        total = (F.size(blocks) - 1) * block + F.length(F.element_at(blocks, -1))
        return let(let(total, lambda n: cut(blocks, n)), lambda ends: pieces(blocks, ends))

    return let(in_blocks, in_order)


def chunk_documents(
    documents: DataFrame, text_column: str = "content", size: int = DEFAULT_SIZE
) -> DataFrame:
    """One row per chunk, numbered from 0; the text column becomes ``content``."""
    others = [c for c in documents.columns if c != text_column]
    return documents.select(
        *others, F.posexplode(chunk_text(F.col(text_column), size)).alias("chunk_number", "content")
    )
