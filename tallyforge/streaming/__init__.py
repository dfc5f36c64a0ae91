"""Row-local operators on streams of incoming items."""
