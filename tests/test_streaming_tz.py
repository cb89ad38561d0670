"""Stream results must not depend on the session time zone (event times are
naive wall-clock values read as UTC)."""

import __spark_entry__ as E
from conftest import SF_SMALL


def test_windows_and_sessions_ignore_session_time_zone(spark, duck):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for name in ("stream_windowed_score", "stream_sessions"):
            df = E.queries()[name](spark, SF_SMALL)
            got = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
            cur = duck.execute(E.oracle_sql()[name])
            cols = [c[0] for c in cur.description]
            idx = [cols.index(c) for c in df.columns]
            want = sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx)
                          for r in cur.fetchall())
            assert got == want, name
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
