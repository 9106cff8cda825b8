"""DuckDB SQL for the results of wayspark.plans.queries, written apart from the operators."""

from __future__ import annotations

import re

from wayspark.plans.queries import BOX, DAILY_STAY, RING, STAY, TM_LON0

A, F_ = "6378137.0::DOUBLE", "(1/298.257223563::DOUBLE)"


def haversine(a: str, b: str, c: str, d: str) -> str:
    s = f"(sin((radians({c})-radians({a}))/2)**2 + cos(radians({a}))*cos(radians({c}))*sin((radians({d})-radians({b}))/2)**2)"
    return f"(2*6371008.8::DOUBLE*asin(sqrt(least(1.0::DOUBLE, {s}))))"


def lambert(table: str, a: str, b: str, c: str, d: str, name: str) -> str:
    """``table`` with the geodesic distance as column ``name``."""
    beta = lambda x: f"atan((1-{F_})*tan(radians({x})))"
    inner = f"select *, {beta(a)} as z1, {beta(c)} as z2, radians({d})-radians({b}) as zl from {table}"
    angle = f"select *, 2*asin(sqrt(least(1.0::DOUBLE, sin((z2-z1)/2)**2 + cos(z1)*cos(z2)*sin(zl/2)**2))) as zs from ({inner})"
    x = "(zs-sin(zs))*(sin((z1+z2)/2)*cos((z2-z1)/2)/cos(zs/2))**2"
    y = "(zs+sin(zs))*(cos((z1+z2)/2)*sin((z2-z1)/2)/sin(zs/2))**2"
    return f"(select * exclude (z1, z2, zl, zs), case when zs = 0 then 0.0 else {A}*(zs-{F_}/2*({x}+{y})) end as {name} from ({angle}))"


SECONDS = lambda a, b: f"((epoch_us({b})-epoch_us({a}))/1e6)"
W = "(partition by participant_id order by ts, event_id)"
WS = "(partition by participant_id order by start_time, stop_seq)"

PARTICIPANT = "((user_id // 20) * 4 + case when user_id % 20 < 12 then 0 else 1 + user_id % 3 end)"

CTES = {
    "pts": f"""select event_id, participant_id, ts, place,
  (488000000 + 500000*(participant_id % 4) + [0,300000,110000,170000,230000][place+1] + ((event_id*7919)%1000-500)*4)::DOUBLE/1e7 as lat,
  (23000000 + 500000*(participant_id % 4) + [0,400000,130000,210000,290000][place+1] + ((event_id*104729)%1000-500)*4)::DOUBLE/1e7 as lon
  from (select event_id, {PARTICIPANT} as participant_id, ts, case when hour(ts) >= 20 or hour(ts) < 8 then 0 when isodow(ts) <= 5 and hour(ts) between 9 and 17 then 1 else 2 + event_id % 3 end as place from events)""",
    "acts": f"select {PARTICIPANT} as participant_id, ts, event_type as activity from events where event_id % 10 = 0",
    "steps": f"""select *, dist_m / nullif(time_diff_s, 0) * 3.6 as speed_kmh from {lambert(f"(select *, {SECONDS(f'lag(ts) over {W}', 'ts')} as time_diff_s, lag(lat) over {W} as zlat, lag(lon) over {W} as zlon from pts)", 'zlat', 'zlon', 'lat', 'lon', 'dist_m')}""",
    "ready": f"select *, avg(speed_kmh) over (partition by participant_id order by ts, event_id rows between 2 preceding and 2 following) as speed_kmh_smooth from steps where speed_kmh is null or speed_kmh <= 150",
    "doubled": "select event_id, participant_id, ts, case when event_id % 11 <> 0 then lat end as lat, lon from pts union all select event_id + 1000000000, participant_id, ts, case when event_id % 11 <> 0 then lat end as lat, lon from pts where event_id % 7 = 0",
    "light": "select * exclude n from (select *, row_number() over (partition by participant_id, ts, lat, lon order by event_id) as n from doubled where lat is not null) where n = 1",
    "stops": f"""select participant_id, stop_seq, min(place) as place, min(ts) as start_time, max(ts) as end_time, avg(lat) as lat, avg(lon) as lon, (max(epoch_us(ts))-min(epoch_us(ts)))/1e6 as duration_s
  from (select *, (sum(c) over {W})::BIGINT as stop_seq from (select *, case when place = lag(place) over {W} then 0 else 1 end as c from pts)) group by all""",
    "typed": "select *, case place when 0 then 'Home' when 1 then 'Work' else 'autre' end as place_type from stops",
    "merged": "select participant_id, place, place_type, sum(duration_s) as duration_s, list(start_time order by start_time) as s, count(*) as visits from typed group by all",
    "close_pairs": f"select a.participant_id, a.stop_seq as a, b.stop_seq as b from stops a join stops b using (participant_id) where {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 150",
    "reach": "select participant_id, a, b from close_pairs union select r.participant_id, r.a, c.b from reach r join close_pairs c on r.participant_id = c.participant_id and r.b = c.a",
    "labels": "select participant_id, a as stop_seq, dense_rank() over (partition by participant_id order by min(b)) - 1 as cluster from reach group by participant_id, a",
    "tpairs": f"select a.participant_id, a.stop_seq as a, b.stop_seq as b from stops a join stops b using (participant_id) where {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 8",
    "cores": "select participant_id, a as core from tpairs group by all having count(*) >= 6",
    "cpairs": "select p.* from tpairs p join cores x on x.participant_id = p.participant_id and x.core = p.a join cores y on y.participant_id = p.participant_id and y.core = p.b",
    "creach": "select participant_id, a, b from cpairs union select r.participant_id, r.a, c.b from creach r join cpairs c on r.participant_id = c.participant_id and r.b = c.a",
    "clabels": "select participant_id, a as core, dense_rank() over (partition by participant_id order by min(b)) - 1 as cluster from creach group by participant_id, a",
    "grouped": f"""select participant_id, min(start_time) as start_time, max(end_time) as end_time, sum(duration_s) as duration_s, avg(lat) as lat, avg(lon) as lon, count(*) as group_size from
  (select *, sum(new) over {WS} as g from (select *, case when {SECONDS('pe', 'start_time')} <= {{gap}} and apart <= {{far}} then 0 else 1 end as new from {lambert(f'(select *, lag(end_time) over {WS} as pe, lag(lat) over {WS} as pa, lag(lon) over {WS} as po from stops)', 'pa', 'po', 'lat', 'lon', 'apart')})) group by participant_id, g""",
    "hpairs": f"select participant_id, a, b from {lambert('(select a.participant_id, a.stop_seq as a, b.stop_seq as b, a.place_type as ta, b.place_type as tb, a.lat as la, a.lon as lo, b.lat as ma, b.lon as mo from typed a join typed b using (participant_id))', 'la', 'lo', 'ma', 'mo', 'd')} where d <= 150 and not (ta in ('Home', 'Work') and tb in ('Home', 'Work') and ta <> tb)",
    "hreach": "select participant_id, a, b from hpairs union select r.participant_id, r.a, c.b from hreach r join hpairs c on r.participant_id = c.participant_id and r.b = c.a",
    "hroots": "select participant_id, a as stop_seq, min(b) as root from hreach group by participant_id, a",
    "gaps_of": f"select participant_id, stop_seq, coalesce(lag(end_time) over {WS}, first_ts) as gs, start_time as ge from {{stops}} join (select participant_id, min(ts) as first_ts from pts group by all) using (participant_id)",
    "moves_mid": f"""select participant_id, min(ts) as start_time, max(ts) as end_time, (max(epoch_us(ts))-min(epoch_us(ts)))/1e6 as duration_s, arg_min(lat, (ts, event_id)) as lat_origin, arg_min(lon, (ts, event_id)) as lon_origin, arg_max(lat, (ts, event_id)) as lat_dest, arg_max(lon, (ts, event_id)) as lon_dest
  from pts join gaps_of g using (participant_id) where {SECONDS('gs', 'ge')} >= 900 and ts between gs and ge group by participant_id, stop_seq having count(*) >= 2 and (max(epoch_us(ts))-min(epoch_us(ts)))/1e6 >= 30""",
    "moves_end": """select participant_id, min(ts) as start_time, max(ts) as end_time, (max(epoch_us(ts))-min(epoch_us(ts)))/1e6 as duration_s, arg_min(lat, (ts, event_id)) as lat_origin, arg_min(lon, (ts, event_id)) as lon_origin, arg_max(lat, (ts, event_id)) as lat_dest, arg_max(lon, (ts, event_id)) as lon_dest
  from pts join (select participant_id, arg_max(end_time, (start_time, stop_seq)) as le from {stops} group by all) using (participant_id) where ts >= le group by participant_id having count(*) >= 2 and (max(epoch_us(ts))-min(epoch_us(ts)))/1e6 >= 30""",
    "moves": "select *, row_number() over (partition by participant_id order by start_time, end_time) as move_id from (select * from moves_mid union all select * from moves_end)",
    "ends": "select participant_id, move_id, 'origin' as side, lat_origin as lat, lon_origin as lon from moves union all select participant_id, move_id, 'destination', lat_dest, lon_dest from moves",
    "near": f"select *, row_number() over (partition by participant_id, move_id, side order by dist_m, stop_seq) as rank from {lambert('(select e.*, t.stop_seq, t.place_type, t.lat as ma, t.lon as mo from ends e join typed t using (participant_id))', 'lat', 'lon', 'ma', 'mo', 'dist_m')} where dist_m <= 200",
    "tagged": f"""select m.*, coalesce(o.place_type, 'unknown') as origin_type, coalesce(t.place_type, 'unknown') as destination_type, coalesce(o.place_type, 'unknown') || ' → ' || coalesce(t.place_type, 'unknown') as transition from {lambert('moves', 'lat_origin', 'lon_origin', 'lat_dest', 'lon_dest', 'dist_m')} m
  left join near o on o.participant_id = m.participant_id and o.move_id = m.move_id and o.side = 'origin' and o.rank = 1 left join near t on t.participant_id = m.participant_id and t.move_id = m.move_id and t.side = 'destination' and t.rank = 1""",
    "firsts": "select participant_id, arg_min(lat, stop_seq) filter (place_type = 'Home') as hlat, arg_min(lon, stop_seq) filter (place_type = 'Home') as hlon, arg_min(lat, stop_seq) filter (place_type = 'Work') as wlat, arg_min(lon, stop_seq) filter (place_type = 'Work') as wlon from typed group by all having hlat is not null and wlat is not null",
    "snaps": "select * exclude (lat_origin, lon_origin, lat_dest, lon_dest), case so when 'Home' then hlat when 'Work' then wlat else lat_origin end as lat_origin, case so when 'Home' then hlon when 'Work' then wlon else lon_origin end as lon_origin, case sd when 'Home' then hlat when 'Work' then wlat else lat_dest end as lat_dest, case sd when 'Home' then hlon when 'Work' then wlon else lon_dest end as lon_dest from (select *, case when d1 <= 150 then 'Home' when d2 <= 150 then 'Work' end as so, case when d3 <= 150 then 'Home' when d4 <= 150 then 'Work' end as sd from "
    + lambert(lambert(lambert(lambert("(select * from tagged left join firsts using (participant_id))", "lat_origin", "lon_origin", "hlat", "hlon", "d1"), "lat_origin", "lon_origin", "wlat", "wlon", "d2"), "lat_dest", "lon_dest", "hlat", "hlon", "d3"), "lat_dest", "lon_dest", "wlat", "wlon", "d4") + ")",
    "covers": "select *, len(list_filter([20,21,22,23,0,1,2,3,4,5,6,7], lambda h: date_trunc('day', start_time) + to_hours(h) between start_time and end_time)) > 0 as ch, len(list_filter(range(7,19), lambda h: date_trunc('day', start_time) + to_hours(h) between start_time and end_time)) > 0 as cw from stops",
    "hzone": "select * exclude n from (select *, row_number() over (partition by participant_id order by zone_s desc, zone_lat, zone_lon) as n from (select participant_id, round_even(lat, 3) as zone_lat, round_even(lon, 3) as zone_lon, sum(duration_s) as zone_s from covers where ch group by all)) where n = 1",
    "homes": f"select *, d <= 100 as is_home from {lambert('(select * from covers left join (select participant_id, zone_lat as hla, zone_lon as hlo from hzone) using (participant_id))', 'lat', 'lon', 'hla', 'hlo', 'd')}",
    "wzone": "select * exclude n from (select *, row_number() over (partition by participant_id order by zone_s desc, zone_lat, zone_lon) as n from (select participant_id, round_even(lat, 3) as zone_lat, round_even(lon, 3) as zone_lon, sum(duration_s) as zone_s from homes where cw and not coalesce(is_home, false) group by all)) where n = 1",
    "hw": f"select * exclude place, case when d5 <= 100 then 'Work' when is_home then 'Home' else 'autre' end as place_type from {lambert('(select * from homes left join (select participant_id, zone_lat as wla, zone_lon as wlo from wzone) using (participant_id))', 'lat', 'lon', 'wla', 'wlo', 'd5')}",
    "hwfirst": "select participant_id, arg_min(lat, stop_seq) filter (place_type = 'Home') as ha, arg_min(lon, stop_seq) filter (place_type = 'Home') as ho, arg_min(lat, stop_seq) filter (place_type = 'Work') as wa, arg_min(lon, stop_seq) filter (place_type = 'Work') as wo from hw group by all having ha is not null and wa is not null",
    "matched": "select s.participant_id, s.stop_seq, any_value(s.duration_s) as duration_s, coalesce(arg_min(activity, (ts, activity)), 'autre') as matched_activity from stops s left join acts a on a.participant_id = s.participant_id and a.ts between s.start_time and s.end_time group by all",
    "minutes": """select participant_id, minute, case when mean is not null then mean when pi is null then null when ni is null then pm else pm + (nm - pm) * (i - pi) / (ni - pi) end as speed_kmh from (
  select *, last_value(case when mean is not null then i end ignore nulls) over b as pi, last_value(mean ignore nulls) over b as pm, first_value(case when mean is not null then i end ignore nulls) over f as ni, first_value(mean ignore nulls) over f as nm from (
  select g.participant_id, g.minute, mean, row_number() over (partition by g.participant_id order by g.minute) as i from (select participant_id, unnest(generate_series(lo, hi, interval 1 minute)) as minute from (select participant_id, min(date_trunc('minute', ts)) as lo, max(date_trunc('minute', ts)) as hi from ready group by all)) g
  left join (select participant_id, date_trunc('minute', ts) as minute, avg(speed_kmh) as mean from ready group by all) m using (participant_id, minute))
  window b as (partition by participant_id order by minute rows between unbounded preceding and current row), f as (partition by participant_id order by minute rows between current row and unbounded following))""",
    "segs": "select participant_id, min(day) as first_date, max(day) as last_date, count(*) as n_days from (select *, day - (row_number() over (partition by participant_id order by day))::INTEGER as g from (select distinct participant_id, ts::DATE as day from pts)) group by participant_id, g",
    "sites": "select s_suppkey as site_id, 256000 + 2.2::DOUBLE*((s_suppkey*7919)%10007) as x, 6245000 + 3.2::DOUBLE*((s_suppkey*104729)%10009) as y, s_nationkey + 1 as cluster_id from supplier",
    "traj": f"select participant_id || '-' || strftime(ts, '%Y%m%d') as traj_id, ts, event_id, {A}*radians(lon) as x, {A}*ln(tan(pi()/4 + radians(lat)/2)) as y, row_number() over (partition by participant_id, ts::DATE order by ts, event_id) as pos from pts",
    "celled": "select traj_id, event_id, pos, t.x, t.y, arg_min(site_id, (sqrt((t.x-s.x)**2+(t.y-s.y)**2), site_id)) as near_site, arg_min(cluster_id, (sqrt((t.x-s.x)**2+(t.y-s.y)**2), site_id)) as cell, min(sqrt((t.x-s.x)**2+(t.y-s.y)**2)) as dist from traj t, sites s group by all",
    "eyes": "select *, first_value(cell) over w as sc, last_value(cell) over w as ec, lead(x) over o as nx, lead(y) over o as ny, lag(x) over o as px, lag(y) over o as py from celled window w as (partition by traj_id order by pos rows between unbounded preceding and unbounded following), o as (partition by traj_id order by pos)",
    "wedged": "select e.event_id, traj_id, pos, cell, sc, ec, "
    + ", ".join(
        f"case when {p}x is not null then (select count(*) from sites s where s.cluster_id = {c} and (abs({{dir}}(s.x-e.x, s.y-e.y) - {{dir}}(e.x-{p}x, e.y-{p}y)) <= 30 or 360 - abs({{dir}}(s.x-e.x, s.y-e.y) - {{dir}}(e.x-{p}x, e.y-{p}y)) <= 30)) end as {n}_in, (select count(*) from sites s where s.cluster_id = {c}) as {n}_n"
        for n, p, c in (("start", "n", "sc"), ("end", "p", "ec"))
    ) + " from eyes e",
    "oked": "select *, cell <> sc as sf, cell <> ec as ef, coalesce(start_in = 0 or start_in = start_n, false) as sk, coalesce(end_in = 0 or end_in = end_n, false) as ek from wedged",
}
CTES["wedged"] = re.sub(r"\{dir\}\(([^,]+), ([^)]+)\)", r"(case when atan2(\2, \1) < 0 then degrees(atan2(\2, \1)) + 360 else degrees(atan2(\2, \1)) end)", CTES["wedged"])


def _stays(p: str, key: str, source: str, stay: tuple[float, float]) -> dict[str, str]:
    """Stays by anchors, of each ``key``: a hop leads to the next point outside the radius."""
    return {
        f"{p}nums": f"select {key}, ts, lat, lon, row_number() over (partition by {key} order by ts, event_id) as rn from {source}",
        f"{p}hops": f"""select {key}, rn, lat, lon from {p}nums where rn = 1 union all
  select {key}, b.rn, b.lat, b.lon from (select a.{key}, min(b.rn) as rn from {p}hops a join {p}nums b on b.{key} = a.{key} and b.rn > a.rn and {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} > {stay[1]} group by all) n join {p}nums b using ({key}, rn)""",
        f"{p}stays": f"""select {key}, row_number() over (partition by {key} order by start_time) as stop_seq, start_time, end_time
  from (select {key}, ts as start_time, lead(ts) over (partition by {key} order by rn) as end_time from {p}hops join {p}nums using ({key}, rn)) where {SECONDS('start_time', 'end_time')} > {stay[0]}""",
    }


CTES |= _stays("p", "participant_id", "pts", STAY) | _stays("t", "traj_id", "(select * from traj join (select event_id, lat, lon from pts) using (event_id))", DAILY_STAY)


def sql(body: str, stops: str = "stops", gap: float = 600, far: float = 200) -> str:
    """``body`` after the definitions that it needs, in order."""
    fill = lambda t: t.replace("{stops}", stops).replace("{gap}", str(gap)).replace("{far}", str(far))
    need: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in re.findall(r"\b[a-z_]+\b", text):
            if name in CTES and name not in need and name != own:
                visit(fill(CTES[name]), name)
                if name not in need:
                    need.append(name)

    visit(fill(body))
    if not need:
        return body
    return "with recursive " + ",\n".join(f"{n} as ({fill(CTES[n])})" for n in need) + "\n" + fill(body)


def _r(*columns: str, digits: int = 3) -> str:
    return ", ".join(f"round({c}, {6 if c.startswith(('lat', 'lon', 'zone_l')) else digits}) as {c}" for c in columns)


MOVE = f"participant_id, start_time, end_time, {_r('duration_s', 'lat_origin', 'lon_origin', 'lat_dest', 'lon_dest')}"
TAGGED = "participant_id, move_id, start_time, end_time, origin_type, destination_type, transition"
GROUPED = f"participant_id, start_time, end_time, {_r('duration_s', 'lat', 'lon')}, group_size"
E2, EP2 = "(0.0066943799901413165::DOUBLE)", "(0.0067394967422764341::DOUBLE)"
BOX_SQL = f"lat > {BOX['lat'][0]} and lat < {BOX['lat'][1]} and lon > {BOX['lon'][0]} and lon < {BOX['lon'][1]}"
TM = f"""select event_id, 500000 + n*(d + (1-t+c)*d**3/6 + (5-18*t+t*t+72*c-58*{EP2})*d**5/120) as east,
 m + n*tan(p)*(d**2/2 + (5-t+9*c+4*c*c)*d**4/24 + (61-58*t+t*t+600*c-330*{EP2})*d**6/720) as north from (
 select *, {A}/sqrt(1-{E2}*sin(p)**2) as n, tan(p)**2 as t, {EP2}*cos(p)**2 as c, radians(lon-{TM_LON0})*cos(p) as d,
 {A}*((1-{E2}/4-3*{E2}**2/64-5*{E2}**3/256)*p-(3*{E2}/8+3*{E2}**2/32+45*{E2}**3/1024)*sin(2*p)+(15*{E2}**2/256+45*{E2}**3/1024)*sin(4*p)-(35*{E2}**3/3072)*sin(6*p)) as m
 from (select *, radians(lat) as p from pts))"""
CROSSINGS = " + ".join(
    f"(case when ({ay} > y) <> ({by} > y) and x < {ax} + ({bx}-{ax})*(y-{ay})/({by}-{ay}) then 1 else 0 end)" for (ax, ay), (bx, by) in zip(RING, RING[1:] + RING[:1])
)


def _hist(source: str, value: str, bins: int, more: str = "") -> str:
    return f"""select participant_id, (case when hi = lo then 0 else least(floor((v-lo)/nullif((hi-lo)/{bins}, 0)), {bins - 1}) end)::INTEGER as bin, count(*) as n{more}
 from (select participant_id, v, min(v) over (partition by participant_id) as lo, max(v) over (partition by participant_id) as hi from (select participant_id, {value} as v from {source}) where v is not null) group by all"""


def _band(k: int, lo: float, hi: float) -> str:
    return f"select participant_id, least(floor((v-{lo}::DOUBLE)/(({hi}::DOUBLE-{lo}::DOUBLE)/14)), 13)::INTEGER as bin, count(*) as n, {k} as band from (select participant_id, round(speed_kmh, 3) as v from ready) where v > {lo} and v <= {hi} group by all"


def _anchor(radius: float, seconds: float) -> str:
    return (
        "with recursive pts as (" + CTES["pts"] + f"""), q as (select *, row_number() over {W} as rn from pts),
 anchors as (select participant_id, rn, lat, lon from q where rn = 1 union all
  select participant_id, b.rn, b.lat, b.lon from (select a.participant_id, min(b.rn) as rn from anchors a join q b on b.participant_id = a.participant_id and b.rn > a.rn and {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} > {radius} group by all) n join q b using (participant_id, rn)),
 j as (select participant_id, rn, lead(rn) over (partition by participant_id order by rn) as nx from anchors),
 k as (select participant_id, j.rn, a.ts as start_time, n.ts as end_time, nx from j join q a using (participant_id, rn) join q n on n.participant_id = j.participant_id and n.rn = j.nx where {SECONDS('a.ts', 'n.ts')} > {seconds})
select participant_id, start_time, end_time, round({SECONDS('start_time', 'end_time')}, 3) as duration_s, round(median(q.lat), 6) as lat, round(median(q.lon), 6) as lon
from k join q using (participant_id) where q.rn >= k.rn and q.rn < k.nx group by participant_id, k.rn, start_time, end_time"""
    )


# stay points of each participant and day by anchors; trajectories split there, their pieces cut at both ends
# Sides of every site's cell: the line half way to another site, or along the envelope, as far as no other site is nearer.
CTES["envelope"] = "select x0 - m as x0, y0 - m as y0, x1 + m as x1, y1 + m as y1 from (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, greatest(max(x) - min(x), max(y) - min(y)) as m from sites)"
CTES["cell_lines"] = """select a.site_id as a, b.site_id as b, a.x as ax, a.y as ay, (a.x+b.x)/2 as mx, (a.y+b.y)/2 as my, (a.y-b.y)/d as ux, (b.x-a.x)/d as uy, d/2 as h
 from sites a join sites b on a.site_id <> b.site_id, lateral (select sqrt((a.x-b.x)**2+(a.y-b.y)**2) as d)
 union all select site_id, null, x, y, k.mx, k.my, k.ux, 1 - k.ux, k.h from sites, envelope, lateral (select unnest([
  {'mx': x0, 'my': y, 'ux': 0.0::double, 'h': x-x0}, {'mx': x1, 'my': y, 'ux': 0.0::double, 'h': x1-x}, {'mx': x, 'my': y0, 'ux': 1.0::double, 'h': y-y0}, {'mx': x, 'my': y1, 'ux': 1.0::double, 'h': y1-y}]) as k)"""
CTES["cell_sides"] = """select a, b, h, least(min(hi), min(case when g < 0 then -q/g end)) - greatest(min(lo), max(case when g > 0 then -q/g end)) as side
 from (select l.*, c.site_id as c, (mx-c.x)**2+(my-c.y)**2-(mx-ax)**2-(my-ay)**2 as q, 2*(ux*(ax-c.x)+uy*(ay-c.y)) as g,
   greatest(least((x0-mx)/nullif(ux, 0), (x1-mx)/nullif(ux, 0)), least((y0-my)/nullif(uy, 0), (y1-my)/nullif(uy, 0))) as lo,
   least(greatest((x0-mx)/nullif(ux, 0), (x1-mx)/nullif(ux, 0)), greatest((y0-my)/nullif(uy, 0), (y1-my)/nullif(uy, 0))) as hi
  from cell_lines l, envelope, sites c where c.site_id <> l.a and c.site_id is distinct from l.b)
 group by a, b, h, mx, my having side > 1e-6 and not bool_or(g = 0 and q < 0)"""

STT_STAYS = (
    "with recursive pts as (" + CTES["pts"] + "), sites as (" + CTES["sites"] + "), traj as (" + CTES["traj"] + "), nearby as (" + CTES["celled"] + f"""),
 q as (select t.traj_id, t.ts, p.lat, p.lon, t.pos as rn from traj t join pts p using (event_id)),
 anchors as (select traj_id, rn, lat, lon from q where rn = 1 union all
  select traj_id, b.rn, b.lat, b.lon from (select a.traj_id, min(b.rn) as rn from anchors a join q b on b.traj_id = a.traj_id and b.rn > a.rn and {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} > {DAILY_STAY[1]} group by all) n join q b using (traj_id, rn)),
 j as (select traj_id, rn, lead(rn) over (partition by traj_id order by rn) as nx from anchors),
 stays as (select j.traj_id, a.ts as start_time, n.ts as end_time from j join q a using (traj_id, rn) join q n on n.traj_id = j.traj_id and n.rn = j.nx where {SECONDS('a.ts', 'n.ts')} > {DAILY_STAY[0]}),
 parts as (select c.*, t.ts, (select count(*) from stays s where s.traj_id = c.traj_id and s.end_time <= t.ts) as piece from nearby c join traj t using (event_id)
  where not exists (select 1 from stays s where s.traj_id = c.traj_id and t.ts > s.start_time and t.ts < s.end_time)),
 celled as (select traj_id || '/' || piece as traj_id, event_id, x, y, near_site, cell, row_number() over (partition by traj_id, piece order by pos) as pos from parts qualify count(*) over (partition by traj_id, piece) > 1),
 eyes as (""" + CTES["eyes"] + "), wedged as (" + CTES["wedged"] + "), oked as (" + CTES["oked"] + """)
select event_id, split_part(traj_id, '/', 1) as traj_id, split_part(traj_id, '/', 2)::BIGINT as piece, pos
from oked join (select traj_id, min(pos) filter (sf and sk) as a, max(pos) filter (ef and ek) as b from oked group by all) using (traj_id) where a < b and pos between a and b"""
)

SQL = {
    "participants": sql("select distinct participant_id from pts"),
    "points_scan": sql("select event_id, participant_id, ts, lat, lon from pts"),
    "activity_scan": sql('select ts as "timestamp", activity from acts where participant_id = 1'),
    "plt_reader": sql(f"select lat, lon, date_trunc('second', ts) as ts from pts where participant_id = 0 and {BOX_SQL}"),
    "cluster_nodes": "select min(s_suppkey) - 1 as site_id, (s_suppkey*7919)%107 as x, (s_suppkey*104729)%109 as y from supplier group by x, y",
    "points_localtime": "select event_id, timezone('Europe/Paris', timezone('UTC', ts)) as local_ts from events",
    "step_time_diff": sql("select event_id, time_diff_s from steps"),
    "step_distance": sql(f"select event_id, {_r('dist_m')} from steps"),
    "step_speed": sql(f"select event_id, {_r('speed_kmh')} from steps"),
    "speed_filter": sql("select event_id, participant_id from ready"),
    "speed_smooth": sql(f"select event_id, {_r('speed_kmh_smooth')} from ready"),
    "time_enrich": sql("select event_id, hour(ts)::INTEGER as hour, dayname(ts) as weekday, (isodow(ts) - 1)::INTEGER as weekday_num, ts::DATE as date, isodow(ts) >= 6 as is_weekend from pts"),
    "clean_light": sql("select event_id, participant_id from light"),
    "clean_full": sql(f"""select event_id, {_r('time_diff_s', 'dist_m')}, coalesce(time_diff_s > 7200, false) as long_gap from {lambert(f"(select *, {SECONDS(f'lag(ts) over {W}', 'ts')} as time_diff_s, lag(lat) over {W} as za, lag(lon) over {W} as zo from "
        + "(select event_id, participant_id, ts, lat, lon from " + lambert(f"(select *, {SECONDS(f'lag(ts) over {W}', 'ts')} as t0, lag(lat) over {W} as ya, lag(lon) over {W} as yo from light)", 'ya', 'yo', 'lat', 'lon', 'd0') + " where d0 is null or (d0 >= 1 and t0 >= 30)))", 'za', 'zo', 'lat', 'lon', 'dist_m')}"""),
    "date_segments": sql("select participant_id, first_date, last_date, n_days from segs"),
    "bbox_filter": sql(f"select event_id from pts where {BOX_SQL}"),
    "stops_anchor": _anchor(100, 300),
    "stops_stt": _anchor(200, 900),
    "dbscan_stops": sql("select participant_id, stop_seq, cluster from labels"),
    "dbscan_general": sql("select participant_id, stop_seq, coalesce(o.cluster, (select min(l.cluster) from tpairs p join clabels l on l.participant_id = p.participant_id and l.core = p.b where p.participant_id = t.participant_id and p.a = t.stop_seq), -1) as cluster from stops t left join (select participant_id, core as stop_seq, cluster from clabels) o using (participant_id, stop_seq)"),
    "cluster_agg": sql("select participant_id, cluster, min(start_time) as start_time, max(end_time) as end_time, round(sum(duration_s), 3) as duration_s, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, count(*) as group_size from stops join labels using (participant_id, stop_seq) group by all"),
    "points_in_clusters": sql("select event_id from pts p where exists (select 1 from pstays s where s.participant_id = p.participant_id and p.ts between s.start_time and s.end_time)"),
    "group_stops": sql(f"select {GROUPED} from grouped", gap=7200, far=12000),
    "merge_close_stops": sql("select participant_id, root, case when bool_or(place_type = 'Home') then 'Home' when bool_or(place_type = 'Work') then 'Work' else 'autre' end as place_type, min(start_time) as start_time, max(end_time) as end_time, round(sum(duration_s), 3) as duration_s, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, count(*) as group_size from typed join hroots using (participant_id, stop_seq) group by participant_id, root"),
    "merge_close_visits": sql("select participant_id, root, stop_seq, start_time, end_time from typed join hroots using (participant_id, stop_seq)"),
    "home_work_centroids": sql("select row_number() over (partition by participant_id order by place_type, lat, lon) as myid, * from (select distinct participant_id, place_type, round_even(lat, 5) as lat, round_even(lon, 5) as lon from typed where place_type <> 'autre')"),
    "moves_between_stops": sql(f"select {MOVE} from moves_mid"),
    "moves_tail": sql(f"select {MOVE} from moves_end", stops="pstays"),
    "split_stop_points": sql("select event_id from pts p where exists (select 1 from pstays s where s.participant_id = p.participant_id and p.ts between s.start_time and s.end_time)"),
    "split_move_points": sql("select event_id from pts p where not exists (select 1 from pstays s where s.participant_id = p.participant_id and p.ts between s.start_time and s.end_time)"),
    "move_sessions": sql(f"select event_id, (sum(n) over {W})::BIGINT as move_id from (select *, case when {SECONDS(f'lag(ts) over {W}', 'ts')} > 900 then 1 else 0 end as n from pts)"),
    "moves_summary": sql("select " + f"participant_id, move_id, {_r('duration_s', 'lat_origin', 'lon_origin', 'lat_dest', 'lon_dest', 'dist_m')}, start_time, end_time from " + lambert(
        f"(select participant_id, move_id::BIGINT as move_id, min(ts) as start_time, max(ts) as end_time, (max(epoch_us(ts))-min(epoch_us(ts)))/1e6 as duration_s, arg_min(lat, (ts, event_id)) as lat_origin, arg_min(lon, (ts, event_id)) as lon_origin, arg_max(lat, (ts, event_id)) as lat_dest, arg_max(lon, (ts, event_id)) as lon_dest from (select *, sum(n) over {W} as move_id from (select *, case when {SECONDS(f'lag(ts) over {W}', 'ts')} > 1800 then 1 else 0 end as n from pts)) group by all having count(*) >= 2 and duration_s >= 60)",
        "lat_origin", "lon_origin", "lat_dest", "lon_dest", "dist_m")),
    "moves_tagged": sql(f"select {TAGGED} from tagged"),
    "moves_distance": sql(f"select participant_id, move_id, {_r('dist_m')} from tagged"),
    "moves_filtered": sql(f"select {TAGGED}, {_r('dist_m')} from tagged where dist_m >= 50 and duration_s <= 21600 and origin_type <> destination_type"),
    "moves_snapped": sql(f"select participant_id, move_id, {_r('lat_origin', 'lon_origin', 'lat_dest', 'lon_dest')}, so as snapped_origin_type, sd as snapped_destination_type, so is not null or sd is not null as snapped from snaps"),
    "moves_snapped_only": sql("select participant_id, move_id, so as snapped_origin_type, sd as snapped_destination_type from snaps where so is not null or sd is not null"),
    "move_dist_home_work": sql("select participant_id, move_id, case when 'Home' in (origin_type, destination_type) then round(dist_m, 3) end as dist_home_m, case when 'Work' in (origin_type, destination_type) then round(dist_m, 3) end as dist_work_m from tagged"),
    "nearest_k_places": sql(f"select participant_id, move_id, side, rank::INTEGER as rank, stop_seq, {_r('dist_m')} from near where rank <= 5"),
    "stops_cover_window": sql("select participant_id, stop_seq, ch as covers_home, cw as covers_work from covers"),
    "home_zone": sql(f"select participant_id, {_r('zone_lat', 'zone_lon', 'zone_s')} from hzone"),
    "work_zone": sql(f"select participant_id, {_r('zone_lat', 'zone_lon', 'zone_s')} from wzone"),
    "home_work": sql("select participant_id, stop_seq, place_type, strftime(start_time, '%Y-%m-%d %H:%M:%S') as starts, strftime(end_time, '%Y-%m-%d %H:%M:%S') as ends from hw"),
    "other_place_distances": sql("select participant_id, stop_seq, " + _r("lat", "lon", "dist_home_m", "dist_work_m") + ", case when dist_home_m < 150 or dist_work_m < 150 then 'Oui' else 'Non' end as suspect from " + lambert(lambert("(select * from hw join hwfirst using (participant_id) where place_type = 'autre')", "lat", "lon", "ha", "ho", "dist_home_m"), "lat", "lon", "wa", "wo", "dist_work_m")),
    "confidence_score": sql("select participant_id, place_type, days::INTEGER as days, round(100*(duration_s/nullif(max(duration_s) over p, 0) + days::DOUBLE/max(days) over p)/2, 1) as confidence from (select *, len(list_distinct(list_transform(s, lambda t: t::DATE))) as days from merged where place_type <> 'autre') window p as (partition by participant_id)"),
    "stop_activity": sql("select participant_id, stop_seq, matched_activity from matched"),
    "activity_minutes": sql("select participant_id, matched_activity, round(sum(duration_s)/60, 3) as total_min from matched group by all"),
    "nearest_place_3857": sql(f"""select s.participant_id, s.stop_seq, place_seq, near_type, round(units, 3) as units from stops s left join (select *, rank() over (partition by participant_id, stop_seq order by units) as k from
 (select a.participant_id, a.stop_seq, b.stop_seq as place_seq, b.place_type as near_type, sqrt(({A}*radians(b.lon)-{A}*radians(a.lon))**2 + ({A}*ln(tan(pi()/4+radians(b.lat)/2))-{A}*ln(tan(pi()/4+radians(a.lat)/2)))**2) as units from stops a join typed b using (participant_id) where b.place_type <> 'autre') where units <= 40) n on n.participant_id = s.participant_id and n.stop_seq = s.stop_seq and n.k = 1"""),
    "places_per_type": sql("select participant_id, place_type, count(*) as n_places from typed group by all"),
    "visits_describe": sql("select participant_id, place_type, count(*) as n, round(avg(visits), 3) as mean, round(stddev_samp(visits), 3) as std, min(visits)::DOUBLE as min, round(quantile_cont(visits, 0.25), 3) as q25, round(quantile_cont(visits, 0.5), 3) as q50, round(quantile_cont(visits, 0.75), 3) as q75, max(visits)::DOUBLE as max from merged group by all"),
    "visit_hours": sql("select participant_id, place_type, hour(start_time)::INTEGER as hour, count(*) as n_visits from typed group by all"),
    "minutes_per_type": sql("select participant_id, place_type, round(sum(duration_s)/60, 3) as minutes from typed group by all"),
    "report_summary": sql("""select participant_id, n_points, round(total_km, 3) as total_km, first_ts, last_ts, n_days, coalesce(n_stops, 0) as n_stops, round(coalesce(stop_min, 0), 3) as stop_min, round(span, 3) as span_min, round(span - coalesce(stop_min, 0), 3) as move_min
 from (select participant_id, count(*) as n_points, sum(dist_m)/1000 as total_km, min(ts) as first_ts, max(ts) as last_ts, count(distinct ts::DATE) as n_days, (max(epoch_us(ts))-min(epoch_us(ts)))/6e7 as span from ready group by all) left join (select participant_id, count(*) as n_stops, sum(duration_s)/60 as stop_min from grouped group by all) using (participant_id)"""),
    "points_per_day": sql("select participant_id, ts::DATE as date, count(*) as n_points from pts group by all"),
    "speed_stats": sql("select participant_id, round(avg(speed_kmh), 3) as mean_speed, round(max(speed_kmh), 3) as max_speed, floor(count(*)/count(distinct ts::DATE))::BIGINT as points_per_day, round(avg(time_diff_s), 3) as mean_interval_s from ready group by all"),
    "speed_by_hour": sql("select participant_id, hour(ts)::INTEGER as hour, round(avg(speed_kmh), 3) as mean_speed, count(speed_kmh) as n from ready group by all"),
    "speed_by_weekday": sql("select participant_id, d::INTEGER as weekday_num, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][d+1] as weekday, round(m, 3) as mean_speed from (select distinct participant_id from ready) cross join range(7) r(d) left join (select participant_id, isodow(ts) - 1 as d, avg(speed_kmh) as m from ready group by all) using (participant_id, d)"),
    "speed_by_daytype_hour": sql("select participant_id, isodow(ts) >= 6 as is_weekend, ts::DATE as date, hour(ts)::INTEGER as hour, round(avg(speed_kmh), 3) as mean_speed from ready group by all"),
    "heat_counts": sql("select participant_id, ts::DATE as date, " + ", ".join(f"count(*) filter (hour(ts) = {h}) as h{h}" for h in range(24)) + " from pts group by all"),
    "heat_speed": sql("select participant_id, ts::DATE as date, " + ", ".join(f"round(coalesce(avg(speed_kmh) filter (hour(ts) = {h}), 0), 3) as h{h}" for h in range(24)) + " from ready group by all"),
    "speed_hist_all": sql(_hist("ready", "case when speed_kmh is not null then least(round(speed_kmh, 3), 80.0::DOUBLE) end", 60)),
    "speed_hist_bands": sql(" union all ".join(_band(k, *b) for k, b in enumerate(((0.0, 3.5), (3.5, 6.5), (6.5, 10.0))))),
    "speed_hist_high": sql(_hist("(select * from ready where speed_kmh > 10)", "round(speed_kmh, 3)", 30)),
    "speed_1min": sql("select participant_id, minute, round(speed_kmh, 3) as speed_kmh from minutes"),
    "speed_rolling": sql("select participant_id, minute, round(avg(speed_kmh) over (partition by participant_id order by minute rows between 5 preceding and 4 following), 3) as rolling_kmh from minutes"),
    "speed_place_type": sql("select m.participant_id, m.minute, coalesce(arg_min(place_type, stop_seq), 'Move') as place_type from minutes m left join typed s on s.participant_id = m.participant_id and m.minute between s.start_time and s.end_time group by all"),
    "move_totals": sql("select participant_id, round(sum(dist_m), 3) as total_m, count(*) as n_moves, round(sum(duration_s)/60, 3) as total_min from tagged group by all"),
    "segment_stats": sql("select s.participant_id, first_date, last_date, count(*) as n_points, round(sum(dist_m)/1000, 3) as total_km, round(avg(speed_kmh), 3) as mean_speed from segs s join ready r on r.participant_id = s.participant_id and r.ts::DATE between first_date and last_date group by all"),
    "map_center": sql("select participant_id, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, count(distinct ts::DATE) as n_days from pts group by all"),
    "stop_marker_style": sql("select participant_id, stop_seq, round(least(10.0, greatest(3.0, duration_s/120)), 3) as radius, case when duration_s/60 < 5 then 'green' when duration_s/60 < 15 then 'orange' else 'red' end as color from stops"),
    "stops_per_day": sql("select participant_id, start_time::DATE as date, count(*) as n_stops from stops group by all"),
    "neighbour_edges": sql("select distinct least(a, b) as source, greatest(a, b) as target, round(d, 3) as length from (select *, row_number() over (partition by a order by d, b) as r from (select p.site_id as a, q.site_id as b, sqrt((p.x-q.x)**2+(p.y-q.y)**2) as d from sites p, sites q where p.site_id <> q.site_id)) where r <= 4"),
    "delaunay_edges": sql("select least(a, b) as source, greatest(a, b) as target, round(min(2*h), 3) as length from cell_sides where b is not null group by all"),
    "voronoi_cells": sql("select a as site_id, round(sum(h*side)/2e6, 3) as area_km2 from cell_sides group by all"),
    "merged_cells": sql("select p.cluster_id, count(distinct a) as n_cells, round(sum(h*side)/2e6, 3) as area_km2, round(sum(case when o.cluster_id is distinct from p.cluster_id then side end)/1e3, 3) as boundary_km from cell_sides join sites p on p.site_id = a left join sites o on o.site_id = b group by all"),
    "cell_of_point": sql("select event_id, near_site, cell::BIGINT as cell, round(dist, 3) as dist from celled"),
    "sensitive_endpoints": sql("select traj_id, " + ", ".join(f"{f}(pos, pos) as {n}_pos, {f}(ts, pos) as {n}_ts, round({f}(x, pos), 3) as {n}_x, round({f}(y, pos), 3) as {n}_y" for n, f in (("first", "arg_min"), ("last", "arg_max"))) + " from traj group by all"),
    "regions_of_points": sql("select event_id, site_id as region_id from traj t, (select site_id, x as cx, y as cy, (300 + (site_id*37)%2900)::DOUBLE as w, (200 + (site_id*53)%1700)::DOUBLE as h from sites) r where ("
        + " + ".join(f"(case when ({ay} > t.y) <> ({by} > t.y) and t.x < {ax} + ({bx}-{ax})*(t.y-{ay})/({by}-{ay}) then 1 else 0 end)" for (ax, ay), (bx, by) in (
            (("(cx-w)", "cy"), ("cx", "(cy+h)")), (("cx", "(cy+h)"), ("(cx+w)", "cy")), (("(cx+w)", "cy"), ("cx", "(cy+h/4)")), (("cx", "(cy+h/4)"), ("(cx-w)", "cy")))) + ") % 2 = 1"),
    "region_filter": sql(f"select event_id from traj where ({CROSSINGS}) % 2 = 1"),
    "pcells": sql("select traj_id, 'first' as side, arg_min(cell, pos)::BIGINT as cell from celled group by all union all select traj_id, 'last', arg_max(cell, pos)::BIGINT from celled group by all"),
    "stt_split": sql("""select event_id, traj_id, piece::BIGINT as piece from (select *, count(*) over (partition by traj_id, piece) as n from (select t.event_id, t.traj_id,
 (select count(*) from tstays s where s.traj_id = t.traj_id and s.end_time <= t.ts) as piece from traj t where not exists (select 1 from tstays s where s.traj_id = t.traj_id and t.ts > s.start_time and t.ts < s.end_time))) where n > 1"""),
    "wedge_counts": sql("select event_id, start_in::INTEGER as start_in, end_in::INTEGER as end_in from wedged"),
    "direction_ok": sql("select event_id, sk as start_clear, ek as end_clear from oked"),
    "proximity_ok": sql("select event_id, sf as start_far, ef as end_far from oked"),
    "stt_truncate": sql("select event_id, traj_id, pos from oked join (select traj_id, min(pos) filter (sf and sk) as a, max(pos) filter (ef and ek) as b from oked group by all) using (traj_id) where a < b and pos between a and b"),
    "stt_stays": STT_STAYS,
    "project_tm": sql(f"select event_id, round(east, 3) as east, round(north, 3) as north from ({TM})"),
    "wedge_triangles": sql("select traj_id, pos, " + _r("x", "y", "direction") + ", " + ", ".join(f"round({c} + 100*{f}(radians(direction {s} 30)), 3) as {c}{k}" for k, s in ((1, "-"), (2, "+")) for c, f in (("x", "cos"), ("y", "sin"))) + ", is_final from (select *, case when atan2(y-ny, x-nx) < 0 then degrees(atan2(y-ny, x-nx)) + 360 else degrees(atan2(y-ny, x-nx)) end as direction from (select *, lead(x) over o as nx, lead(y) over o as ny, lag(pos) over o is null as is_final from traj window o as (partition by traj_id order by pos))) where direction is not null"),
    "bbox_overlap": sql("select traj_id from traj group by all having min(x) <= 262000 and max(x) >= 257000 and min(y) <= 6250000 and max(y) >= 6246000"),
}
SQL |= {f"{name}_in_spans": SQL[name] for name in ("step_distance", "speed_smooth", "move_sessions")}
