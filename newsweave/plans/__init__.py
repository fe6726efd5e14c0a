"""Query templates and pipelines."""
