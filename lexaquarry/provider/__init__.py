"""Clients of model services: one request with retries, failures in classes, chat and embeddings."""
