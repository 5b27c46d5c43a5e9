"""Manifests, findings, traces and differences as text: JSON, YAML, SARIF and a summary; and as tables."""
