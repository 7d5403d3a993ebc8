"""Names, aliases, codes and constants of the telemetry data model.

Nothing here is logic.  These are plain lookup values that uploaded tables are
written against, so they have to be equal letter for letter.
"""

# --- fixed values: file kinds -------------------------------------------------
TEXT_SUFFIXES = (".csv", ".tsv", ".txt", ".tab", ".dat")
JSON_SUFFIXES = (".json", ".jsonl", ".ndjson")
COLUMNAR_SUFFIXES = (".parquet", ".pq", ".feather", ".arrow", ".ipc")
ARRAY_SUFFIXES = (".npy", ".npz")
OTHER_DATA_SUFFIXES = (".xlsx", ".xls", ".xlsm", ".xlsb", ".ods", ".mat", ".h5", ".hdf5")
ARCHIVE_SUFFIXES = (
    ".zip", ".7z", ".rar", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".gz",
)

# --- fixed values: limits -----------------------------------------------------
MAX_FILES = 32
MAX_COLUMNS = 32
MAX_FILE_BYTES = 8 * 1024 * 1024
MAX_TOTAL_BYTES = 32 * 1024 * 1024
MAX_RECORDS_PER_FILE = 250_000
MAX_WINDOWS_PER_FILE = 5_000
MAX_TRACE_POINTS = 8_000
MAX_NAME_LENGTH = 160

# --- fixed values: channels ---------------------------------------------------
BATTERY_CHANNELS = ("bat.capacity_ah", "bat.ir_proxy_ohm", "bat.temp_mean_c", "bat.charge_time_s")
BATTERY_REQUIRED = ("bat.capacity_ah", "bat.temp_mean_c", "bat.charge_time_s")
WHEEL_BASE_CHANNELS = ("rw.speed_rpm", "rw.motor_current_a", "rw.bearing_temp_c")
WHEEL_STATISTICS = ("mean", "std", "min", "max")
WHEEL_FRICTION = "rw.fric_tc.mean"
WHEEL_CHANNELS = (
    "rw.speed_rpm.mean", "rw.speed_rpm.std", "rw.speed_rpm.min", "rw.speed_rpm.max",
    "rw.motor_current_a.mean", "rw.motor_current_a.std", "rw.motor_current_a.min", "rw.motor_current_a.max",
    "rw.bearing_temp_c.mean", "rw.bearing_temp_c.std", "rw.bearing_temp_c.min", "rw.bearing_temp_c.max",
    "rw.fric_tc.mean",
)

CHANNEL_ALIASES = {
    "bat.capacity_ah": ("capacity_ah", "battery_capacity_ah", "电池容量ah", "容量ah", "容量(Ah)"),
    "bat.ir_proxy_ohm": ("ir_proxy_ohm", "battery_ir_proxy_ohm", "内阻代理ohm", "内阻代理(ohm)"),
    "bat.temp_mean_c": (
        "temp_mean_c", "battery_temp_mean_c", "battery_temperature_c", "电池温度c",
        "电池温度(℃)", "电池平均温度c",
    ),
    "bat.charge_time_s": (
        "charge_time_s", "battery_charge_time_s", "充电时长s", "充电时间s", "充电时间(秒)",
    ),
    "rw.speed_rpm": ("reaction_wheel_speed_rpm", "wheel_speed_rpm", "转速rpm", "转速(rpm)"),
    "rw.motor_current_a": ("reaction_wheel_current_a", "wheel_current_a", "电机电流a", "电机电流(a)"),
    "rw.bearing_temp_c": ("reaction_wheel_bearing_temp_c", "轴承温度c", "轴承温度(℃)"),
    **{channel: () for channel in WHEEL_CHANNELS},
}

CHANNEL_UNITS = {
    "bat.capacity_ah": "Ah",
    "bat.ir_proxy_ohm": "ohm",
    "bat.temp_mean_c": "degC",
    "bat.charge_time_s": "s",
    "rw.speed_rpm": "rpm",
    "rw.motor_current_a": "A",
    "rw.bearing_temp_c": "degC",
    "rw.speed_rpm.mean": "rpm",
    "rw.speed_rpm.std": "rpm",
    "rw.speed_rpm.min": "rpm",
    "rw.speed_rpm.max": "rpm",
    "rw.motor_current_a.mean": "A",
    "rw.motor_current_a.std": "A",
    "rw.motor_current_a.min": "A",
    "rw.motor_current_a.max": "A",
    "rw.bearing_temp_c.mean": "degC",
    "rw.bearing_temp_c.std": "degC",
    "rw.bearing_temp_c.min": "degC",
    "rw.bearing_temp_c.max": "degC",
    "rw.fric_tc.mean": "A",
}
UNIT_ALIASES = {
    "Ah": ("ah", "ampere-hour", "ampere hour", "ampere-hours", "安时", "安培小时"),
    "ohm": ("ohm", "ohms", "Ω", "Ω", "欧姆"),
    "degC": ("degc", "degree celsius", "degrees celsius", "°c", "℃", "摄氏度"),
    "s": ("s", "sec", "secs", "second", "seconds", "秒"),
    "rpm": ("rpm", "r/min", "rev/min", "revolutions/minute", "转/分", "转每分钟"),
    "A": ("a", "amp", "amps", "ampere", "amperes", "安培"),
}

# --- fixed values: headers ----------------------------------------------------
TIME_UNIT_HEADERS = {
    "cycle": (
        "cycle", "cycle_index", "cycle(index)", "cycle[index]", "循环", "循环数",
        "循环序号", "循环序号(cycle)", "时间_循环", "时间(循环)", "时间[循环]",
    ),
    "millisecond": (
        "time_ms", "time(ms)", "time[ms]", "milliseconds", "时间_毫秒", "时间(毫秒)", "时间[毫秒]",
    ),
    "second": ("time_s", "time(s)", "time[s]", "seconds", "时间_秒", "时间(秒)", "时间[秒]"),
    "minute": (
        "time_min", "time(min)", "time[min]", "minutes", "时间_分钟", "时间(分钟)", "时间[分钟]",
    ),
    "hour": ("time_h", "time(h)", "time[h]", "hours", "时间_小时", "时间(小时)", "时间[小时]"),
    "day": ("time_day", "time(day)", "time[day]", "days", "时间_天", "时间(天)", "时间[天]"),
    "bin": (
        "time_bin", "time(bin)", "time[bin]", "bin", "时间_桶", "时间(桶)", "时间[桶]",
        "时间桶", "已聚合时间桶",
    ),
}
GENERIC_TIME_HEADERS = (
    "time", "timestamp", "datetime", "date_time", "t", "sample_index", "sample_clock",
    "step", "step_index", "index", "时间", "时刻", "采样时间", "时间戳", "时间(time)",
)
HEADER_ALIASES = {
    "time": GENERIC_TIME_HEADERS + tuple(a for group in TIME_UNIT_HEADERS.values() for a in group),
    "telemetry": (
        "telemetry_name", "telemetry_variable", "channel", "channel_name", "metric", "variable",
        "signal", "遥测量", "遥测量名称", "遥测参数", "参数", "测点", "变量", "遥测量(telemetry)",
    ),
    "value": (
        "reading", "measurement", "telemetry_value", "数值", "值", "测量值", "遥测值", "值(value)",
    ),
}
METADATA_ALIASES = {
    "unit": ("units", "engineering_unit", "measurement_unit", "value_unit", "单位", "量纲"),
    "component": (
        "component_type", "component_name", "subsystem", "part", "组件", "部件", "组件类型",
        "部件类型", "子系统",
    ),
    "component_id": (
        "componentid", "asset_id", "device_id", "unit_id", "sample_id", "组件编号", "组件标识",
        "部件编号", "设备编号", "样本编号",
    ),
    "orbit_altitude_km": ("orbit_altitude", "altitude_km", "轨道高度", "轨道高度_km"),
    "orbit_inclination_deg": ("orbit_inclination", "inclination_deg", "轨道倾角", "轨道倾角_deg"),
    "orbital_period_min": ("orbit_period_min", "orbital_period", "轨道周期", "轨道周期_min"),
    "orbit_perigee_altitude_km": ("perigee_altitude_km", "近地点高度", "近地点高度_km"),
    "orbit_apogee_altitude_km": ("apogee_altitude_km", "远地点高度", "远地点高度_km"),
    "orbit_eccentricity": ("eccentricity", "轨道偏心率", "偏心率"),
    "orbit_semi_major_axis_km": ("semi_major_axis_km", "轨道半长轴", "半长轴_km"),
    "orbit_speed_km_s": ("orbital_speed_km_s", "轨道速度", "轨道速度_km_s"),
    "orbit_raan_deg": ("raan_deg", "raan", "升交点赤经", "升交点赤经_deg"),
    "orbit_arg_periapsis_deg": ("arg_periapsis_deg", "近地点幅角", "近地点幅角_deg"),
    "orbit_true_anomaly_deg": ("true_anomaly_deg", "真近点角", "真近点角_deg"),
    "operating_condition": (
        "condition", "operating_mode", "operating_regime", "regime", "工况", "运行工况",
        "工作状态", "工况标识",
    ),
    "degradation_state": (
        "degradation", "health_state", "label.hi", "hi_label", "health_index_label", "退化状态",
        "健康状态", "退化阶段",
    ),
    "rul": (
        "remaining_useful_life", "remaining_life", "residual_life", "rul_label", "label.rul",
        "剩余使用寿命", "剩余寿命", "剩余寿命标签",
    ),
    "life_label": ("lifetime_label", "life_stage", "寿命标签", "寿命阶段"),
    "failure_label": (
        "failure", "failure_state", "fault_label", "label.fail", "label.failure", "失效标签",
        "故障标签",
    ),
}
TARGET_METADATA = ("rul", "life_label", "failure_label")
FUTURE_MARKERS = ("future", "target", "label", "truth", "ytrue", "未来", "真值", "标签")

# --- fixed values: time -------------------------------------------------------
SECONDS_PER_UNIT = {"millisecond": 0.001, "second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}
ORBIT_PERIOD_S = 5740.0
SAMPLE_PERIOD_S = 10.0
SAMPLES_PER_ORBIT = 574
BIN_WIDTH_S = 574.0
#: Age of a wheel at which the weights of the blend change.
WHEEL_AGE_THRESHOLD_S = 21810.0

# --- fixed values: failure modes and data dictionary --------------------------
FAILURE_CODES = {
    0: "none",
    1: "rw_wear_over_threshold",
    2: "rw_speed_tracking_fail",
    3: "rw_lube_sudden_loss",
    11: "bat_soh_le_80",
    12: "bat_micro_short",
}
LABEL_ATTRIBUTES = ("criterion_text", "failure_mode_code", "failure_time_days")
NOMINAL_CAPACITY_AH = 2.0
END_OF_LIFE_SOH = 0.80
WEAR_LIMIT_MM3 = 2.0
FRICTION_LIMIT_NM = 0.045
HEALTH_INDEX_MAX = 1.5
LABEL_ATOL = 2e-4
LABEL_STRICT_TOL = 1e-6

# name: (unit, visibility, dtype); "t_unit" is the time unit of the dataset
CHANNEL_DICTIONARY = {
    "t": ("t_unit", "index", "float64"),
    "orbit.eclipse_flag": ("-", "env", "int8"),
    "orbit.beta_deg": ("deg", "env", "float32"),
    "rw.speed_rpm": ("rpm", "telemetry", "float32"),
    "rw.motor_current_a": ("A", "telemetry", "float32"),
    "rw.cmd_torque_nm": ("N·m", "telemetry", "float32"),
    "rw.bearing_temp_c": ("degC", "telemetry", "float32"),
    "bat.voltage_v": ("V", "telemetry", "float32"),
    "bat.current_a": ("A", "telemetry", "float32"),
    "bat.temp_c": ("degC", "telemetry", "float32"),
    "bat.soc": ("0-1", "telemetry", "float32"),
    "rw.friction_torque_nm": ("N·m", "privileged", "float32"),
    "rw.wear_volume_mm3": ("mm3", "privileged", "float32"),
    "rw.lube_level": ("0-1", "privileged", "float32"),
    "bat.soh": ("0-1", "privileged", "float32"),
    "bat.lli": ("0-1", "privileged", "float32"),
    "bat.lam": ("0-1", "privileged", "float32"),
    "bat.capacity_ah": ("Ah", "telemetry", "float32"),
    "bat.temp_mean_c": ("degC", "telemetry", "float32"),
    "bat.charge_time_s": ("s", "telemetry", "float32"),
    "bat.c_rate_mean": ("1/h", "telemetry", "float32"),
    "label.rul": ("t_unit", "label", "float32"),
    "label.hi": ("0-1+", "label", "float32"),
    "label.fail": ("0/1", "label", "int8"),
}

# --- fixed values: sample identifiers -----------------------------------------
DESIGN_ID_PATTERN = r"^(RWA|BAT)_([A-Za-z0-9]+)_B(\d+)_H(\d+)_L(\d+)_S(\d+)$"
DEV_ID_PATTERN = r"^(RWA|BAT)_dev_S(\d+)$"
MASK_PATTERN = r"(?i)_S(21|22)(\d)"

# --- fixed values: model ------------------------------------------------------
MEMBER_SEEDS = (17, 42, 73)
STATISTICS = (
    "last", "first", "delta", "mean", "std", "min", "max", "q25", "q50", "q75", "slope",
    "tail_mean", "head_mean",
)
AGE_FEATURES = ("age_ratio", "age_ratio_squared", "age_ratio_sqrt")
INVARIANT_REDUCERS = ("mean", "std", "min", "max")

# --- fixed values: orbits and policy ------------------------------------------
EARTH_MU_KM3_S2 = 398600.4418
EARTH_RADIUS_KM = 6378.137
MIN_PERIGEE_KM = 120.0
HEALTH_ZONES = ((0.0, 0.6, "nominal"), (0.6, 0.85, "caution"), (0.85, 1.5, "critical"))
CRITICAL_SHARE = 0.45
MAINTENANCE_MARGIN = {"battery": 15.0, "wheel": 0.03}
NOTE_FIELDS = ("romax_product", "romax_version", "bearing_catalog_entry", "loss_model", "lubricant")

# fixed values: public names of fields in answers
PUBLIC_NAMES = {
    "manifest_sha256": "model_version_hash",
    "member_sha256s": "member_hashes",
    "interval_member_seeds": "member_count",
    "production_point_seed": "selected_member",
    "uncertainty_mode": "uncertainty_description",
    "input_contract": "input_requirements",
}
