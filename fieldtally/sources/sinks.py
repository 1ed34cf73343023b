"""Writing report tables, one folder per sheet and run date."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally import domains as D
from fieldtally.operators.cleaning import ensure_columns, stringify_all


@dataclass(frozen=True)
class Block:
    """Columns of a table that go next to each other on a sheet.

    ``columns`` are names, or places in the table; ``None`` is all of them.
    """

    start_row: int
    start_col: int
    columns: tuple[str | int, ...] | None = None


# First row, first column and columns of each block of a sheet.
LAYOUT: dict[str, tuple[Block, ...]] = {
    "t06_species_detail": (Block(9, 2),),
    "t06_marine_species": (Block(9, 2),),
    "t07_aquaculture": (Block(8, 2),),
    "t05_marine_province": (Block(8, 2, (0, 1)), Block(8, 5, (2,))),
    "t04_rice_field": (Block(10, 2, (0, 1)), Block(10, 5, (2,))),
    "t03_fishery_domain": (Block(9, 2, (0, 1)), Block(9, 5, (2,))),
    "t02_dai": (Block(11, 2, (0, 1)), Block(11, 5, (2,))),
    "t08_enforcement": (Block(7, 2, (0, 1, 2, 3)),),
    "t10_facilities": (
        Block(8, 2, ("province_kh",)),
        Block(8, 5, ("ponds",)),
        Block(8, 9, ("batches",)),
        Block(8, 13, ("plastic soung",)),
    ),
}


def report_layout(df: DataFrame, blocks: Iterable[Block]) -> DataFrame:
    """A table's columns in sheet order, each with its cell as ``row`` and ``col`` metadata.

    Columns a block names that the table lacks are 0.  Columns past the last place, such as
    further years, follow in the last block.
    """
    blocks = list(blocks)
    df = ensure_columns(df, [c for b in blocks for c in b.columns or () if isinstance(c, str)])
    placed = []
    for block in blocks:
        if block.columns is None:
            names = df.columns
        elif isinstance(block.columns[0], str):
            names = block.columns
        else:
            stop = None if block is blocks[-1] else block.columns[-1] + 1
            names = df.columns[block.columns[0]:stop]
        for step, name in enumerate(names):
            cell = {"row": block.start_row, "col": block.start_col + step}
            placed.append(F.col(f"`{name}`").alias(name, metadata=cell))
    return df.select(*placed)


def write_report_bundle(
    reports: Mapping[str, DataFrame],
    out: str,
    run_date: datetime.date | None = None,
    fmt: str = "csv",
) -> dict[str, str]:
    """Writes each report, laid out and as text, to ``out/<sheet>/run_date=<day>``.

    A run replaces what an earlier run of the same day wrote.  ``sheet_row`` is the row of the
    sheet that a row of the report fills, from its first block's row down; a sheet has a million
    rows at most, so one task numbers them, in the order of the report, and writes one file.
    Parquet keeps the cells as column metadata.  A few sheets are written at a time.  Returns each
    one's folder.
    """
    day = (run_date or datetime.date.today()).isoformat()

    def write(name: str) -> str:
        blocks = LAYOUT.get(name, (Block(1, 1),))
        placed = report_layout(reports[name], blocks).coalesce(1)
        row = F.monotonically_increasing_id() + blocks[0].start_row
        placed = placed.withColumn("sheet_row", row.cast("int"))
        target = f"{out}/{D.SHEETS.get(name, name)}/run_date={day}"
        writer = stringify_all(placed).write.mode("overwrite").format(fmt)
        (writer.option("header", "true") if fmt == "csv" else writer).save(target)
        return target

    with ThreadPoolExecutor(max_workers=4) as pool:
        return dict(zip(reports, pool.map(write, reports)))
