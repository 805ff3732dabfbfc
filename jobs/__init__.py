"""Jobs that are run by hand or by a scheduler: python -m jobs.gage_report --config jobs/gage_report.toml ..."""
