"""Small array fixtures in long form."""

import numpy as np


def signals_df(spark, cube):
    """cube: {subject: array (t, region)}"""
    rows = [
        (int(s), t, r, float(x[t, r])) for s, x in cube.items() for t in range(x.shape[0]) for r in range(x.shape[1])
    ]
    return spark.createDataFrame(rows, "subject long, t int, region int, value double")


def stream_df(spark, links, subject=0, window=10):
    """links: array (pairs, frames)"""
    rows = []
    for pair in range(links.shape[0]):
        i = int((np.sqrt(8 * pair + 1) + 1) // 2)
        j = pair - i * (i - 1) // 2
        rows += [(subject, window, f, i, j, pair, float(links[pair, f])) for f in range(links.shape[1])]
    return spark.createDataFrame(
        rows, "subject long, window_size int, frame int, i int, j int, pair_id int, fc double"
    )


def values(df, key_cols, value):
    return {tuple(r[c] for c in key_cols): r[value] for r in df.collect()}
