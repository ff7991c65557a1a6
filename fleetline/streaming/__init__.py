from fleetline.streaming import dedup, retries  # noqa: F401
from fleetline.streaming.alert_stream import AlertRule, AlertStore, alert_stream  # noqa: F401
from fleetline.streaming.queue_store import QueueStore  # noqa: F401
from fleetline.streaming.streams import (current_status, drain_batch, drain_stream,  # noqa: F401
                                         heartbeat_stream, merge_status, process_heartbeat_batch,
                                         process_webhook_batch, rate_stream, status_store,
                                         webhook_stream)
