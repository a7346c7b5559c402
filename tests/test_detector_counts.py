from datetime import datetime, timedelta

from casewright.detect.detectors import BY_ID
from casewright.schema import Case

AT = datetime(2024, 1, 1)


def test_dhcp_network_config_grows_with_the_data(spark):
    rows = [(4200, AT + timedelta(minutes=i)) for i in range(75)]
    case = Case(spark, None, {"evtx_events": spark.createDataFrame(rows, "event_id int, timestamp timestamp")})
    assert BY_ID["dhcp_network_config"].run(case).count() == 75


def test_amcache_ghost_grows_with_the_data(spark):
    rows = [(f"C:\\t\\{i}.exe", AT) for i in range(620)]
    case = Case(spark, None, {"amcache": spark.createDataFrame(rows, "path string, first_seen timestamp"), "mft": spark.createDataFrame([("C:/t/0.exe",)], "path string")})
    assert BY_ID["amcache_ghost"].run(case).count() == 619
