"""Entities, jobs, pipelines and registered queries."""
