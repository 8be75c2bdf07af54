"""Registered queries against their SQL in DuckDB."""

import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")

from snapfold.plans import library  # noqa: E402, F401  registers its queries
from snapfold.plans.queries import ORACLES, QUERIES  # noqa: E402

#: Older whole-job queries of a few tables; those over the whole library are all run here.
SLOW = ("m25_merge_all", "v14_self_verify", "v15_idempotence", "m25_whole_counts")
WHOLE = ("m25_whole_library", "v12_whole_references", "v12_all_references", "v13_all_constraints", "v13_whole_constraints", "v14_whole_self_verify", "v15_whole_idempotence", "v15_nothing_lost", "w2_verify_whole", "s8_report_text", "s8_report_parsed")
SOME = [n for n in ORACLES if n not in SLOW and n[0] in "pmvi" and int(n[1:].split("_")[0]) % 2 == 0] + ["a2_action_counts", "a4_media_counts", "i3_settle", "f1_short_hex", "f4_unique_name", "f6_names", "f7_stamps", "s5_discover", "m11_block_ranges_final", "i1_folder_fingerprints", "i5_next_state", "i11_forget_delete_rename", "m13_bookmarks", "m17_playlist_items", *WHOLE]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(df: pd.DataFrame) -> list:
    value = lambda x: "~" if x is None or x is pd.NA or x is pd.NaT or x != x else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", dict.fromkeys(SOME))
def test_equal(spark, duck, name):
    mine, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert plain(mine) == plain(want)
