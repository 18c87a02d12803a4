"""These must equal the logger's own for right results."""

# Motor class code and upper impulse bound in newton seconds.
MOTOR_CLASSES = [
    ("1/8A", 0.3125),
    ("1/4A", 0.625),
    ("1/2A", 1.25),
    ("A", 2.5),
    ("B", 5.0),
    ("C", 10.0),
    ("D", 20.0),
    ("E", 40.0),
    ("F", 80.0),
    ("G", 160.0),
    ("H", 320.0),
    ("I", 640.0),
    ("J", 1280.0),
    ("K", 2560.0),
    ("L", 5120.0),
    ("M", 10240.0),
    ("N", 20480.0),
    ("O", 40960.0),
]
UNCLASSED = "Unknown"

# Commands a stand understands.
COMMANDS = [
    "ready",
    "safe",
    "launch",
    "post-launch",
    "fill-relay-on",
    "fill-relay-off",
    "dump-relay-on",
    "dump-relay-off",
    "start-cameras",
    "stop-cameras",
]

# Commands that set the control state from anywhere, and the state a stand boots in.
STATE_SETTING_COMMANDS = ["ready", "safe", "start-cameras", "stop-cameras"]
INITIAL_STATE = "safe"

RELAYS = ["fill_solenoid", "dump_solenoid", "ignition", "warn_lights"]

# Device status bits.
SCAN_RUNNING = 2
SCAN_OVERRUN = 4

# Converter: 12-bit codes over +-10 V, 8 channels, 70 MHz pacer clock.
CODE_ZERO = 2048
VOLT_SPAN = 10.0
DEVICE_CHANNELS = 8
PACER_CLOCK_HZ = 70e6
PACED_RATE_LIMIT_HZ = 100_000.0
FAST_MODEL_RATE_LIMIT_HZ = 500_000.0
FAST_MODEL = "205"
IMMEDIATE_BELOW_HZ = 100

# Calibration memory image.
CAL_DATE_OFFSET = 0x40
SERIAL_OFFSET = 0x2F8
SERIAL_LENGTH = 8

# Burn detection.
START_FRACTION = 0.10
END_FRACTION = 0.05
END_SEARCH_DELAY_SEC = 0.01
REPORT_MARGIN_SEC = 5.0
DEFAULT_THRUST_SENSOR = "Load Cell"

NEWTONS_PER_POUND = 4.448222

# Live view.
VIEW_SECONDS = 120
VIEW_PADDING = 50.0
VIEW_MARGIN = 2
VIEW_TAIL = 10
RAW_AXIS_LIMIT = 12.0

# Acknowledgement waits, in seconds.
DEFAULT_ACK_TIMEOUT_SEC = 1
COMMAND_ACK_TIMEOUT_SEC = 60

CALIBRATION_RATE_HZ = 200
CALIBRATION_SECONDS = 10
