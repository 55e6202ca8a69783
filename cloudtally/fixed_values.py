"""Constants that decide results and therefore must not drift.

Everything here is data (weights, thresholds, word lists, patterns); no logic.
"""

# --- instance reference: type, vCPU, RAM in GB; the order settles ties -------
INSTANCE_SPECS = (
    ("t3.nano", 2, 0.5),
    ("t3.micro", 2, 1.0),
    ("t3.small", 2, 2.0),
    ("t3.medium", 2, 4.0),
    ("t3.large", 2, 8.0),
    ("t3.xlarge", 4, 16.0),
    ("m5.large", 2, 8.0),
    ("m5.xlarge", 4, 16.0),
    ("m5.2xlarge", 8, 32.0),
    ("m5.4xlarge", 16, 64.0),
    ("c5.large", 2, 4.0),
    ("c5.xlarge", 4, 8.0),
    ("c5.2xlarge", 8, 16.0),
    ("c5.4xlarge", 16, 32.0),
    ("r4.large", 2, 15.25),
    ("r4.xlarge", 4, 30.5),
    ("r4.2xlarge", 8, 61.0),
    ("r4.4xlarge", 16, 122.0),
    ("r5.large", 2, 16.0),
    ("r5.xlarge", 4, 32.0),
    ("r5.2xlarge", 8, 64.0),
    ("r5.4xlarge", 16, 128.0),
    ("x1e.xlarge", 4, 122.0),
    ("x1e.2xlarge", 8, 244.0),
    ("z1d.xlarge", 4, 32.0),
    ("z1d.2xlarge", 8, 64.0),
    ("d2.xlarge", 4, 30.5),
    ("d2.2xlarge", 8, 61.0),
    ("d2.4xlarge", 16, 122.0),
    ("d2.8xlarge", 36, 244.0),
    ("db.t3.medium", 2, 4.0),
    ("db.m5.large", 2, 8.0),
    ("db.r5.large", 2, 16.0),
)

# one tier down inside a family
DOWNSIZE = {
    "m5.4xlarge": "m5.2xlarge",
    "m5.2xlarge": "m5.xlarge",
    "m5.xlarge": "m5.large",
    "c5.4xlarge": "c5.2xlarge",
    "c5.2xlarge": "c5.xlarge",
    "c5.xlarge": "c5.large",
    "r4.4xlarge": "r4.2xlarge",
    "r4.2xlarge": "r4.xlarge",
    "r4.xlarge": "r4.large",
    "r5.4xlarge": "r5.2xlarge",
    "r5.2xlarge": "r5.xlarge",
    "r5.xlarge": "r5.large",
    "t3.xlarge": "t3.large",
    "t3.large": "t3.medium",
    "t3.medium": "t3.small",
}

# --- machine matching ---------------------------------------------------------
MATCH_MIN_CONFIDENCE = 0.55
MATCH_CPU_WEIGHT = 0.5
MATCH_MEMORY_WEIGHT = 0.5
MATCH_SIZE_RANGE = (0.4, 2.5)
MATCH_DECAY = 3.0
RATE_TIERS = ("on_demand", "spot", "prediction")

# --- uploaded billing files ----------------------------------------------------
REQUIRED_COLUMNS = ("date", "service", "resource_id", "cost")
OPTIONAL_COLUMNS = (
    "cpu_avg_pct", "memory_avg_pct", "instance_type", "region", "account_id", "usage_hours",
)
HEADER_ALIASES = {
    "date": ("date", "usagedate", "billingdate", "usagestartdate", "day"),
    "service": ("service", "productname", "servicename", "product"),
    "resource_id": ("resourceid", "resource", "instanceid", "lineitemresourceid"),
    "cost": ("cost", "amount", "unblendedcost", "totalcost", "charge"),
    "cpu_avg_pct": ("cpuavgpct", "cpuutilization", "cpupercent", "avgcpu"),
    "memory_avg_pct": ("memoryavgpct", "memoryutilization", "memorypercent", "avgmemory"),
    "instance_type": ("instancetype", "instance", "type"),
    "region": ("region", "awsregion", "location"),
    "account_id": ("accountid", "account", "lineitemusageaccountid"),
    "usage_hours": ("usagehours", "hours", "usageamount"),
}
NUMERIC_UPLOAD_COLUMNS = ("cost", "cpu_avg_pct", "memory_avg_pct", "usage_hours")

# --- raw machine telemetry -----------------------------------------------------
TELEMETRY_COLUMNS = (
    "VM_ID", "Datetime", "CPU_Cores", "CPU_Capacity_MHz", "CPU_Usage_MHz", "CPU_Usage_Percent",
    "Memory_Provisioned_KB", "Memory_Usage_KB", "Disk_Read_KBps", "Disk_Write_KBps",
    "Network_Received_KBps", "Network_Transmitted_KBps",
)

# --- price-list header signatures ---------------------------------------------
PRICE_HEADER_WORDS = {
    "prediction": ("pricepredict", "predictedprice", "forecast"),
    "instance_type": ("instancetype", "instantype"),
    "price": ("price",),
    "spot_price": ("spotprice",),
    "region": ("region",),
    "zone": ("availabilityzone", "az"),
    "os": ("productdescription", "os"),
    "timestamp": ("timestamp",),
    "date": ("timestamp", "date"),
    "actual_price": ("realaws", "actualprice", "spotprice"),
    "confidence": ("confidence",),
}
WHOLE_WORD_HEADERS = ("os", "az")
ZONE_PATTERN = r"([a-z]+-[a-z]+-\d+)[a-z]$"

# --- waste score -----------------------------------------------------------------
WASTE_WEIGHTS = {"cpu": 0.30, "memory": 0.20, "growth": 0.20, "idle": 0.20, "history": 0.10}
WASTE_BANDS = ((75.0, "Critical Waste"), (50.0, "Idle"), (25.0, "Underutilized"))
WASTE_FLOOR = "Healthy"
IDLE_CPU_PCT = 10.0
IDLE_WINDOW_ROWS = 30
CLASSIFIER_FEATURES = (
    "cpu_avg_pct", "memory_avg_pct", "cost", "runtime_days", "cost_growth_rate",
    "anomaly_history_count",
)
LABEL_BANDS = ((5.0, "Critical Waste"), (20.0, "Idle"), (40.0, "Underutilized"))

# --- incident score -----------------------------------------------------------------
INCIDENT_WEIGHTS = {
    "cost": 0.35,
    "cpu_avg_pct": 0.20,
    "memory_avg_pct": 0.15,
    "network_io": 0.15,
    "disk_io": 0.15,
}
SEVERITY_BANDS = ((45.0, "critical"), (30.0, "high"), (18.0, "medium"))
SEVERITY_FLOOR = "low"
ZSCORE_LAG, ZSCORE_ROWS, ZSCORE_MIN_ROWS, ZSCORE_CLIP = 7, 30, 5, 10.0
ANOMALY_PERCENTILE = 0.97

# --- risk, confidence, impact -----------------------------------------------------
RISK_TERMS = {  # weight, low, high
    "forecast_growth_pct": (0.4, -20.0, 50.0),
    "waste_ratio_pct": (0.3, 0.0, 100.0),
    "anomaly_count": (0.3, 0.0, 50.0),
}
CONFIDENCE_WEIGHTS = {"classifier": 0.35, "anomaly": 0.20, "forecast": 0.20, "data_quality": 0.25}
CONFIDENCE_DEFAULTS = {"classifier": 0.85, "anomaly": 0.0, "forecast": 0.8, "data_quality": 0.95}
IMPACT_BANDS = ((50.0, "High"), (15.0, "Medium"))
IMPACT_FLOOR = "Low"
MONTH_HOURS = 720.0
DAY_HOURS = 24.0
RECOMMENDATION_STATUSES = ("open", "accepted", "dismissed")

# --- drift and retraining -----------------------------------------------------------
PSI_BINS, PSI_FLOOR, PSI_LIMIT = 10, 1e-4, 0.2
KS_PVALUE_LIMIT = 0.05
MAPE_INCREASE_LIMIT_PCT = 15.0
RETRAIN_DAYS = 7
MODEL_TYPES = ("forecast", "anomaly", "waste_classifier")

# --- questions -------------------------------------------------------------------------
INTENT_PATTERNS = (
    (r"why.*(bill|cost|spend).*(increase|went up|higher|jump)", "bill_increase_explanation"),
    (r"(which|what).*(instance|resource|vm).*(terminate|shut|remove)", "termination_candidates"),
    (r"(show|list|find).*(idle|unused|underutilized)", "idle_resources"),
    (r"compare.*(last|previous).*(month|week).*(this|current)", "period_comparison"),
    (r"(which|what).*(highest|most|top).*(network|cpu|memory|disk)", "highest_metric_resource"),
    (r"forecast.*(cost|spend)", "forecast_request"),
)
INTENT_FLOOR = "general_question"
REGION_PATTERN = r"\b((?:us|eu|ap|sa|ca)-[a-z]+-\d)\b"
SERVICE_PATTERN = r"\b(ec2|s3|rds|lambda)\b"
METRIC_PATTERN = r"\b(network|cpu|memory|disk)\b"
METRIC_COLUMNS = {
    "network": "network_io", "cpu": "cpu_avg_pct", "memory": "memory_avg_pct", "disk": "disk_io",
}

# --- chart bands ------------------------------------------------------------------------
INCIDENT_CHART_BANDS = ((50.0, "50+"), (40.0, "40-50"), (30.0, "30-40"), (20.0, "20-30"))
INCIDENT_CHART_FLOOR = "0-20"
WASTE_CHART_BANDS = ((75.0, "75-100"), (50.0, "50-75"), (25.0, "25-50"))
WASTE_CHART_FLOOR = "0-25"

GENERIC_CITATION = "AWS Well-Architected Cost Optimization (general guidance, citation unavailable)"
