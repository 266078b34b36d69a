"""Where data comes from: configuration, raw files, HTTP requests, message queues."""
