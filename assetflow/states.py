"""Names of the pipeline's states."""

# The states in pipeline order.
STATES = ["discovered", "preview_failed", "preview_ready", "description_failed", "description_ready", "embedding_failed", "embedding_ready", "package_ready", "registered", "uploaded", "committed", "synced"]
FAILED = ["preview_failed", "description_failed", "embedding_failed"]
RESUMABLE = ["discovered", "preview_ready", "preview_failed", "description_ready", "description_failed", "embedding_ready", "embedding_failed", "package_ready"]
#: What a new request for the same content continues, and what it reuses.
CONTINUED = [*RESUMABLE, "registered"]
REUSABLE = ["uploaded", "committed", "synced"]
