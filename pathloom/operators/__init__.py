"""Graph operators: functions from graphs and side tables to tables or graphs."""
