"""Fixed values and default parameters."""

#: All that follows. The study area (least and greatest latitude and longitude), the mode names in the
#: raw records, station aliases, prior headways, the hours of periods, speeds and dwell times, and the patterns of names:
#: brackets, terminals, spellings of line variants that are shortened, variants after a line's number, and the ends of bus names.
BBOX = (39.833217, 116.271581, 39.989478, 116.487437)
MODES = {"公交": "bus", "地铁": "subway"}
STATION_ALIASES = {"灵镜胡同": "灵境胡同", "T2航站楼": "2号航站楼", "T3航站楼": "3号航站楼"}
SUBWAY_HEADWAY_PRIOR_S = {"all": 300.0, "am_peak": 180.0, "pm_peak": 180.0, "off_peak": 360.0, "night": 480.0}
PERIOD_HOURS = {
    "am_peak": [7, 8],
    "pm_peak": [17, 18],
    "night": [22, 23, 0, 1, 2, 3, 4],
    "off_peak": [5, 6, 9, 10, 11, 12, 13, 14, 15, 16, 19, 20, 21],
}
EARTH_RADIUS_M = 6371000.0
WALK_SPEED = 1.2
TRANSFER_DEFAULT_S = {"subway": 240.0, "bus": 60.0}
INTERMODAL_S = 180.0
MODE_SPEED_KMH = {"subway": 35.0, "bus": 18.0}
MODE_DWELL_S = {"subway": 35.0, "bus": 25.0}
HEADWAY_BY_HOUR = {"subway": {7: 180.0, 12: 360.0, 17: 180.0, 22: 480.0}, "bus": {7: 420.0, 12: 600.0, 22: 900.0}}
BRACKETS = "[（(].*?[）)]"
TERMINALS = r"^(.*?)[（(](.*?)--(.*?)[）)]\s*$"
SHORTENED = {"内环": "内", "外环": "外", "快车": "快", "路": ""}
VARIANTS = "(内|外|快|区间|支|定班)+$"
BUS_ENDS = "(内|外|内环|外环|快|快车|区间|支|支线|夜|定班)$"
