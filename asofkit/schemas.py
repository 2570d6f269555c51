"""Declared schemas and fixed values of the domain tables."""

BAR = ("instrument string, timeframe string, open_time timestamp, close_time timestamp, open decimal(20,8), high decimal(20,8), "
       "low decimal(20,8), close decimal(20,8), volume decimal(28,8), source string, collected_at timestamp, effective_at timestamp")
MACRO = ("source string, event_code string, country string, event_at timestamp, released_at timestamp, vintage_end_at timestamp, "
         "actual_value decimal(28,10), unit string, collected_at timestamp, effective_at timestamp")
NEWS = ("event_id string, source string, headline string, event_type string, sentiment decimal(12,10), importance decimal(12,10), "
        "published_at timestamp, effective_at timestamp")
RAW_ITEM = ("source string, source_record_id string, item_type string, title string, content_text string, raw_json string, source_url string, "
            "content_hash string, published_at timestamp, collected_at timestamp, effective_at timestamp")
POST = ("post_id string, author_id string, account_id string, source_name string, text_content string, has_media boolean, "
        "published_at timestamp, collected_at timestamp, effective_at timestamp")
OPINION = ("opinion_id string, author_id string, post_id string, instrument string, stance string, horizon string, confidence decimal(12,10), "
           "entry_low decimal(20,8), entry_high decimal(20,8), stop_loss decimal(20,8), take_profit decimal(20,8), information_type string, "
           "parser_version string, effective_at timestamp")
RUN = ("source string, started_at timestamp, finished_at timestamp, status string, inserted_count int, duplicate_count int, failed_count int, error_message string")

# Enumerations of the data model.
TIMEFRAME_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}
REGIMES = ["TREND_UP", "TREND_DOWN", "RANGE", "HIGH_VOLATILITY", "LOW_VOLATILITY", "NEWS_DRIVEN", "UNKNOWN"]
STANCES = ["LONG", "SHORT", "FLAT", "UNKNOWN"]
HORIZONS = ["15m", "30m", "1h", "4h", "1d"]
RELATIONS = ["REPOST", "QUOTE", "SEMANTIC_SIMILAR", "SAME_SOURCE"]
