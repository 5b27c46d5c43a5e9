"""Whole analyses: from source files to manifests, traces and differences."""
