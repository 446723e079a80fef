"""No product aborts the others: zero demand, zero price, no earlier sales."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from granary.plans import catalogue
from tests.conftest import SF

KEYS = """FIL05 FIL06 INV02 INV04 INV05 INV14 INV15 INV16 INV17 RSK02 RSK03 WIN02 WIN03 WIN04 WIN05 WIN16 DEC01 DEC03
SCN01 SEN01 MKD01 MAP13 MAP15 TSF11 AGG03 AGG26 FIL17""".split()


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """The smallest data set with parts that sell nothing, cost nothing, or never change."""
    folder = tmp_path_factory.mktemp("zeros")
    for name in os.listdir(SF):
        table = pq.read_table(f"{SF}/{name}")
        if name == "lineitem.parquet":
            part = table["l_partkey"].to_numpy()
            quantity = np.where(part % 5 == 0, 0, np.where(part % 5 == 1, 3, table["l_quantity"].to_numpy()))
            table = put(table, "l_quantity", quantity)
            table = put(table, "l_extendedprice", np.where(part % 5 == 2, 0, table["l_extendedprice"].to_numpy().astype(float)))
        elif name == "part.parquet":
            table = put(table, "p_retailprice", np.where(table["p_partkey"].to_numpy() % 5 == 2, 0, table["p_retailprice"].to_numpy().astype(float)))
        pq.write_table(table, folder / name)
    return str(folder)


def put(table, name, values):
    k = table.schema.get_field_index(name)
    return table.set_column(k, table.schema.field(k), pa.array(values).cast(table.schema.field(k).type))


@pytest.mark.parametrize("key", KEYS)
def test_zero_rows_do_not_abort(spark, zeros, key):
    catalogue.runnable()[key](spark, zeros).collect()
