"""Bindings that turn the driver tables into domain tables, in Spark and in DuckDB SQL.

The test data has no logs or telemetry, so operators run on views derived from
the given tables. Each binding is one SQL text valid in both engines (``{T}``
stands for the log-time rendering, which differs).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Case:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a binding over the given tables."""
    for name in TABLES:
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


SPARK_TIME = "date_format(t, 'MMM d yyyy HH:mm:ss')"
DUCK_TIME = "strftime(t, '%b %-d %Y %H:%M:%S')"

# Every code family, ANSI colours, pager marks, terminal noise, exact repeats
# (times cut to the hour) and unset clocks, all driven by the events table.
LOG = """
select source, ord,
  case when k = 20 then 'sw' || host || '#show logging'
       when k = 21 then 'Logging source configurations'
       when k = 22 and ord % 2 = 0 then '   '
       when k = 22 then 'free text without a code ' || cast(ord as string)
       else case when k in (0, 7, 9) then chr(27) || '[0m' || chr(27) || '[1;' || cast(33 + ord % 5 as string) || 'm' else '' end
         || case when k = 5 then '---MORE---      ' else '' end
         || case when k = 11 then 'Jan 1 1970 00:00:15' when k = 23 then 'no time' else {T} end
         || case when k = 23 then '' else ' sw' || host || ' ' || case when ord % 3 = 0 then 'MPU0 ' else '' end || body end
         || case when k in (0, 7, 9) then chr(27) || '[0m' else '' end
  end as line
from (
  select event_id as ord, 'site' || cast(user_id % 3 as string) as source, event_id % 24 as k,
    cast(user_id % 5 as string) as host,
    case when event_id % 24 in (6, 7, 8) then date_trunc('hour', ts) when event_id % 24 in (0, 1, 10, 12) then date_trunc('day', ts) else ts end as t,
    case event_id % 24
      when 0 then '%PORTMGR-LINEPROTO_DOWN-3:Line protocol on interface gi0/' || cast(user_id % 4 as string) || ', changed state to down.'
      when 1 then '%PORTMGR-LINEPROTO_UP-5:Line protocol on interface gi0/' || cast(user_id % 4 as string) || ', changed state to up.'
      when 2 then '%LINK-INTERFACE_DOWN-2:Interface link, changed state to down.'
      when 3 then '%FDB-MAC_ADDR_FLAPPING_VLAN-5:Mac address 0060.2b01.36' || cast(10 + event_id % 5 as string) || ' in vlan '
        || cast(100 + user_id % 3 as string) || ' has moved from port gi0/1 to port interface gi0/' || cast(event_id % 7 as string) || ' for ' || cast(event_id % 150 as string) || ' times'
      when 4 then '%FDB-MAC_ADDR_FLAPPING_VLAN-5:Mac address unreadable moved for 120 times'
      when 5 then '%ARP-MAC_CHANGE_TOO_FAST-5:Ether address of host 192.168.100.' || cast(user_id % 50 as string) || ' change too fast, may be duplicate IP address in the network.'
      when 6 then '%SNMP-COMMUNITY_AUTHOR_FAILED-3:Community ' || case when event_id % 2 = 0 then 'public' else 'site' || cast(user_id % 3 as string) end || ' authentication failed.'
      when 7 then '%SNMP-USER_AUTH_FAILED-3:User op' || cast(user_id % 2 as string) || ' authentication failed.'
      when 8 then '%POE-POWER_ABNORMAL-3:' || case when user_id % 2 = 0 then 'Short detected' else 'Overload' end || ' on interface gi0/' || cast(user_id % 4 as string) || '.'
      when 9 then '%POE-POWER_ON-6:Power on interface gi0/' || cast(user_id % 4 as string) || '.'
      when 10 then '%ERPS-RING_STAT_CHG-4:The state of ERPS ring ' || cast(user_id % 3 as string) || ' was changed to Protection from Idle.'
      when 11 then '%DCM-PROCESS_START-5:Process sysmgmtaddr is starting...'
      when 12 then '%ERPS-RING_PORT_BLK-4:The state of ERPS port te0/' || cast(user_id % 5 as string) || ' was changed to Blocking on ring ' || cast(user_id % 3 as string) || '.'
      when 13 then '%SYSMGMT-PWR_FAIL-1:Power ' || cast(1 + user_id % 2 as string) || ' failed.'
      when 14 then '%SYSMGMT-FAN_ONLINE-5:Fan 1 was inserted.'
      when 15 then '%SYSMGMT-FAN_FAIL-0:Fan ' || cast(1 + user_id % 3 as string) || ' stopped.'
      when 16 then '%HA-UNIT_STATE_NORMAL-5:Unit 0 is up.'
      when 17 then '%CLKM-DEV_CLOCK_CHANGE-6:Clock was set.'
      when 18 then '%TELNET-LOGIN_OK-5:Telnet(vty0) opened by (192.168.100.' || cast(user_id % 9 as string) || ') OK.'
      when 19 then case when user_id % 2 = 0 then '%WEB-LOGIN_OK-6:Web(10.0.0.' || cast(user_id % 200 as string) || ') login OK.'
        when user_id % 3 = 0 then '%SYSMGMT-4:unclassified event' else '%AAA-OTHER' || cast(user_id % 40 as string) || '-7:unclassified event' end
      else '%SYSMGMT-' || case when ord_odd = 1 then '4' else 'OTHER-7' end || ':unclassified event'
    end as body
  from (select *, event_id % 2 as ord_odd from events) e
) x
"""

SERIES = """
select event_id, ts, cast(user_id % 20 as string) as device_id, event_type as interface_id,
       sum(cast(round(value * 100) as bigint)) over (partition by user_id % 20, event_type
           order by ts, event_id rows unbounded preceding) % 200000 as octets,
       case when event_id % 11 = 0 then null else value end as cpu,
       case when event_id % 3 < 2 then 1 else 2 end as status
from events
"""

PRED = """
select l_orderkey, l_linenumber, l_returnflag as y_true,
       case when l_quantity < 17 then 'A' when l_quantity < 34 then 'N' else 'R' end as y_pred,
       l_discount as score
from lineitem
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = LOG.replace("{T}", SPARK_TIME)
    # the generated row keeps the long CASE of this binding from being copied into every later regex
    return bind(spark, sf_dir, f"select source, ord, explode(array(line)) as line from ({text})")


LOG_SQL = LOG.replace("{T}", DUCK_TIME)
