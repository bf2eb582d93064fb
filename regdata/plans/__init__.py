"""Reports: functions from tables to the numbers that were published as charts and facts."""
